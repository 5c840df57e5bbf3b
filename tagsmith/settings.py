"""The values that decide, in one place and checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Shares from 0 to 1: text_match (ratio from which unequal texts match), field_match, overall_pass, logo_match. ocr_floor: least
    confidence of the second engine, in percent; psm: the first engine's page mode; max_bytes: of a request's files; ocr_scale: of images before OCR.
    """

    text_match: float = 0.98
    field_match: float = 0.88
    overall_pass: float = 0.90
    logo_match: float = 0.72
    ocr_floor: float = 25.0
    psm: int = 6
    max_bytes: int = 50 * 1024 * 1024
    ocr_scale: float = 2.0

    def __post_init__(self):
        for name in ("text_match", "field_match", "overall_pass", "logo_match"):
            if not 0 <= float(getattr(self, name)) <= 1:
                raise ValueError(f"{name} must be from 0 to 1, not {getattr(self, name)}")
        if not 0 <= self.ocr_floor <= 100:
            raise ValueError("ocr_floor must be from 0 to 100")
        if self.psm < 0:
            raise ValueError("psm must not be negative")
        if self.max_bytes <= 0 or self.ocr_scale <= 0:
            raise ValueError("max_bytes and ocr_scale must be over zero")


DEFAULT = Settings()
