import json

from conftest import SF0001

from matchlake.sources import events as ev
from matchlake.sources.files import land_snapshot, newest_files
from matchlake.sources.tables import Tables


def _docs(spark, payloads):
    return spark.createDataFrame([(json.dumps(p) if not isinstance(p, str) else p,) for p in payloads], "json string")


def test_null_or_empty_events_yield_no_rows(spark):
    docs = _docs(spark, [{"events": [{"idEvent": "1", "strStatus": "Match Finished"}]}, {"events": []},
                         {"events": None}, {}])
    assert [r.match_data.idEvent for r in ev.explode_documents(docs).collect()] == ["1"]
    v = ev.variant_fields(ev.explode_documents_variant(docs)).collect()
    assert [r.match_data.idEvent for r in v] == ["1"]
    assert v[0].match_data.idHomeTeam is None  # missing field -> NULL


def test_documents_round_trip_and_bounded_pages(spark):
    e = ev.event_rows(Tables(spark, SF0001))
    docs = ev.event_documents(e, page_size=100)
    assert docs.count() > 1
    back = ev.explode_documents(docs).select("match_data.*")
    assert back.exceptAll(e).count() == 0 and e.exceptAll(back).count() == 0


def test_strict_and_lenient_casts(spark):
    from matchlake.plans.marts import fct_matches
    bad = {"idEvent": "x1", "strStatus": "Match Finished", "dateEvent": "2024-01-02", "intHomeScore": "2"}
    stg = ev.explode_documents(_docs(spark, [{"events": [bad]}]))
    r = fct_matches(stg, strict=False).first()
    assert r.match_id is None and r.home_team_score == 2
    try:
        fct_matches(stg, strict=True).collect()
        raise AssertionError("ANSI cast should fail")
    except Exception as e:  # CAST_INVALID_INPUT
        assert "CAST" in str(e).upper()


def test_land_snapshot_guard(spark, tmp_path):
    p = str(tmp_path / "snap")
    assert land_snapshot(_docs(spark, [{"events": []}]), p) is False
    assert land_snapshot(_docs(spark, [{"events": [{"idEvent": "1"}]}]), p) is True
    assert land_snapshot(_docs(spark, [{"events": []}]), p) is False
    assert spark.read.text(p).count() == 1   # the good snapshot was kept


def test_newest_files_listing(spark):
    rows = newest_files(spark, SF0001, 5, "*.parquet").collect()
    assert len(rows) == 5 and all(r.path.endswith(".parquet") for r in rows)
    assert [r.modificationTime for r in rows] == sorted([r.modificationTime for r in rows], reverse=True)


def test_read_landed_multiline_documents(spark, tmp_path):
    p = tmp_path / "season.json"
    p.write_text(json.dumps({"events": [{"idEvent": "5", "strStatus": "Match Finished"}]}, indent=2))
    assert [r.match_data.idEvent for r in ev.read_documents(spark, str(p)).collect()] == ["5"]
