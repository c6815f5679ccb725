"""The registered queries on the smallest tables, and the pipeline against plain code."""

import __spark_entry__ as entry
import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
from brute import crc, fold, leaks, near_groups
from check import compare, duck
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
OURS = sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit())


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in OURS) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", OURS)
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert compare(duck(FOLDER), sql, df) is None
    else:
        table = "pages" if "page_id" in df.columns else "documents"
        assert df.count() >= spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_pipeline(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    rows = [(d, t) for d, t in zip(docs.doc_id, docs.text) if any(c.isalpha() for c in t or "")]
    seen, once = set(), []
    for d, t in rows:
        if fold(t) not in seen:
            seen.add(fold(t))
            once.append((d, t))
    near = [(d, t) for (d, t), (_, _, c) in zip(once, near_groups(once)) if d == c]
    clean = [(d, t) for d, t in near if not leaks(t, list(zip(items.item_id, items.text)))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, n, crc(ids[a : a + 4096])) for n, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got) == sorted(want)


def test_language_stage_without_labels(spark):
    rows = [(1, "the cat", None), (2, None, None), (3, "12 !", None), (4, "\n中", None), (None, "été", None), (5, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mark")
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["\n中", "the cat", "été"]


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows and ids, extra columns: each stage keeps its columns and one row of a group."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "en"), (1, long, "en"), (2, long.upper(), "en"), (1, long + " more", "fr"), (3, None, "en"),
            (4, "  ", None), (None, "the quick brown fox", "en"), (None, "the quick brown fox", "en"), (5, "jumped over", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mark", "2 AS kept")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "mark", "kept"]
        sizes.append(docs.count())
    assert sizes == [7, 4, 3, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 3


ELSEWHERE = """
import importlib.util, os, sys
sys.path.insert(0, os.environ["TOKENIZERS_AT"])
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from shelfwise.session import build_session
spark = build_session("elsewhere", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
for name in sys.argv[3:]:
    print(name, len(entry.queries()[name](spark, sys.argv[2]).collect()))
"""


def test_started_in_another_folder(tmp_path):
    """Workers have no copy of the package; collect() runs the functions that count() would leave out."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TOKENIZERS_AT": str(Path(public_tokenizers.__file__).parent)}
    names = ["op7_decontamination", "op8_language_id", "op11_source_divergence", "op12_vector_search", "op13_ranked_documents"]
    run = subprocess.run(
        [sys.executable, "-c", ELSEWHERE, entry.__file__, FOLDER, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert [line.split()[0] for line in run.stdout.splitlines() if line.startswith("op")] == names, run.stderr[-2000:]
