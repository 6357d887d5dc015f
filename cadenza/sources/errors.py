"""Errors as data: what a bad stream gives instead of failing the job."""

from __future__ import annotations


class AudioError(ValueError):
    """code is one of UnsupportedFormat, InvalidPcm, InvalidInput, UnsupportedFeature, Incomplete."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


def incomplete(detail: str = "") -> AudioError:
    return AudioError("Incomplete", detail)


def invalid(detail: str) -> AudioError:
    return AudioError("InvalidInput", detail)
