"""Errors of decoders, by code; readers turn them into an error column or raise them."""


class AudioError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


def bad_header(detail: str) -> AudioError:
    return AudioError("InvalidHeader", detail)


def bad_data(detail: str) -> AudioError:
    return AudioError("DecodeError", detail)


def ended(detail: str = "") -> AudioError:
    return AudioError("EndOfStream", detail)
