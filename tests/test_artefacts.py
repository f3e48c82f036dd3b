"""Results as files."""

import pytest

from barloom.operators import patterns as C
from barloom.sources import artefacts as A
from barloom.sources import synthetic as S


def test_tables_and_studies_come_back(spark, tmp_path):
    found = C.scan(S.shape(spark, "Double Top"))
    view = A.result_view(found)
    assert view.count() == found.count() > 0 and "points" not in view.columns and view.first()["n_points"] >= 2
    for kind in ("csv", "json", "parquet"):
        A.save_study(str(tmp_path / kind), {"matches": found, "view": view}, {"pattern": "all", "split": "1999-01-01"}, kind)
        tables, meta = A.load_study(spark, str(tmp_path / kind))
        assert set(tables) == {"matches", "view"} and tables["matches"].count() == found.count() and meta["split"] == "1999-01-01"
    A.save_table(view, str(tmp_path / "one"), "csv", 1)
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1
    with pytest.raises(ValueError):
        A.save_table(view, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        A.save_study(str(tmp_path / "y"), {}, {})
