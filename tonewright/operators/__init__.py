"""DataFrame operators over samples, frames and packets."""
