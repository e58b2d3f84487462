"""Logs, statistics, pairs of questions and answers, and what holds without the corpus operators."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from weftgraph.sources import records, tree
from weftgraph.streaming.querylog import QueryLogger, SearchStatistics, follow

REPO = Path(__file__).resolve().parents[1]


def test_broken_log_lines_are_left_out(spark, tmp_path):
    good = {"timestamp": 1.5, "query": "q", "session_id": "s", "result_uris": ["a"], "top_k": 5}
    lines = [json.dumps(good), "", "  ", "{broken", json.dumps({**good, "extra": 1}), json.dumps({k: v for k, v in good.items() if k != "top_k"}), "[]", "3"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert [tuple(r) for r in records.read_log(spark, str(tmp_path / "log.jsonl")).collect()] == [(1.5, "q", "s", ["a"], 5)]
    assert records.count(spark, str(tmp_path / "log.jsonl")) == 8


def test_logger_and_archive(spark, tmp_path):
    logger = QueryLogger(spark, str(tmp_path / "log"), batch_size=3, window=1)
    assert logger.log("q", "s", ["A"], 5) is None and logger.log("q", "s", ["B"], 5) is None
    assert logger.log("q", "s", ["A"], 5).count() == 0
    assert records.archive(spark, logger.path).endswith(".processed") and not records.exists(spark, logger.path)
    asked = []
    stats = SearchStatistics(spark, str(tmp_path / "stats"), batch_size=2)
    assert stats.log("name", "x", ["n"], lambda: asked.append(1)) is None
    assert stats.log("name", "x", ["n"], lambda: asked.append(1)) and asked == [1]


def test_streamed_log(spark, tmp_path):
    for s in ("s1", "s2"):
        rows = [(float(i), "q", s, [u], 5) for i, u in enumerate("ABABA")]
        records.append(spark, str(tmp_path / "log"), rows)
    seen = []
    follow(spark, str(tmp_path / "log"), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), window=1, every=10).awaitTermination()
    assert seen == [2]


def test_pairs_of_a_list(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"query": "a", "answer": "b"}, {"query": 3, "answer": "b"}, {"query": "x"}, "text"], indent=2))
    assert [tuple(r) for r in records.read_pairs(spark, str(tmp_path / "p.json")).collect()] == [("a", "b")]
    for bad in ('{"query": "a"}', '[{"query": 1}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            records.read_pairs(spark, str(tmp_path / "bad.json"))


def test_snippets(spark, tmp_path):
    (tmp_path / "a.java").write_text("class A {}")
    (tmp_path / "b.java").write_text(" \n")
    assert tree.snippet(spark, str(tmp_path / "a.java"), "does a")["code"] == "class A {}"
    for path, told in (("a.java", " "), ("b.java", "x")):
        with pytest.raises(ValueError):
            tree.snippet(spark, str(tmp_path / path), told)


def test_nothing_else_needs_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "weftgraph"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else _copied(REPO / name, tmp_path / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    entry = (REPO / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def _copied(source, target):
    import shutil

    shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))


def test_pairs_round_trip(spark, tmp_path):
    rows = [(f'q "{i}" é', f"line\n[{i}]") for i in range(20)]
    pairs = spark.createDataFrame(rows, "query string, answer string").repartition(3)
    for array in (False, True):
        records.write_pairs(pairs, str(tmp_path / f"p{array}"), array)
        assert sorted(tuple(r) for r in records.read_pairs(spark, str(tmp_path / f"p{array}")).collect()) == sorted(rows)
    (part,) = (tmp_path / "pTrue").glob("part-*")
    assert len(json.loads(part.read_text())) == 20
    records.write_pairs(pairs.limit(0), str(tmp_path / "none"), True)
    with pytest.raises(ValueError):
        records.read_pairs(spark, str(tmp_path / "none"))
