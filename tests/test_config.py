import pytest

from folioscope.config import ConfigError, Settings, load


def test_defaults_types_and_blanks():
    got = load({"FOLIOSCOPE_ROUTE_LIMIT": "7", "FOLIOSCOPE_RERANK_MIN_SCORE": "0.3", "FOLIOSCOPE_CHILD_LIMIT": " "})
    assert (got.route_limit, got.rerank_min_score, got.child_limit) == (7, 0.3, Settings().child_limit)


def test_all_errors_come_at_once():
    with pytest.raises(ConfigError) as e:
        load({"FOLIOSCOPE_ROUTE_LIMIT": "x", "FOLIOSCOPE_OVERLAP_RATIO": "0.9", "FOLIOSCOPE_RERANK_MIN_SCORE": "nan"})
    assert len(str(e.value).splitlines()) == 3
    with pytest.raises(ConfigError):
        load({"FOLIOSCOPE_PARENT_LIMIT": "10"})


def test_the_key_is_not_shown():
    assert "secret" not in repr(load({"FOLIOSCOPE_API_KEY": "secret"}))


def test_a_timeout_may_be_none():
    read = lambda raw: load({"FOLIOSCOPE_ANSWER_TIMEOUT": raw}).answer_timeout
    assert read("None") is None and read("") is None and read("2.5") == 2.5
    for raw in ("0", "-1", "soon", "nan"):
        with pytest.raises(ConfigError):
            read(raw)
    assert load({"FOLIOSCOPE_INDEX_PATH": "s3a://b/i"}).index_path == "s3a://b/i"
    with pytest.raises(ConfigError):
        load({"FOLIOSCOPE_EVIDENCE_RATIO": "0.7"})
