import pytest

from tagsmith.operators import compare, logo, ocr_plan
from tagsmith.settings import DEFAULT, Settings
from tagsmith.sources import files


def test_one_place_for_values():
    assert (compare.TEXT_MATCH, compare.FIELD_MATCH, compare.PASS_MARK, logo.PASS_MARK, files.MAX_BYTES) == (0.98, 0.88, 0.90, 0.72, 52428800)
    assert ocr_plan.OcrSettings().psm == DEFAULT.psm == 6


@pytest.mark.parametrize("bad", [{"text_match": 1.01}, {"field_match": -0.1}, {"overall_pass": 2}, {"logo_match": float("nan")}, {"ocr_floor": 101}, {"ocr_floor": -1}, {"psm": -1}, {"max_bytes": 0}, {"ocr_scale": 0.0}])
def test_values_out_of_range(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
