"""Registered queries: oracle equality, schemas and plans; the pipeline against a plain version."""

import contextlib
import io
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import brute
import corpus_pipeline
from conftest import SF_SMALL
from tidewatch.llm import queries
from tools.oracle_check import TABLES, norm


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns) and _rows(df.columns, df.collect()) == _rows(cols, cur.fetchall())


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


def test_native_operators_run_no_python(spark):
    for name in ("op4_quality_rules", "op10_mix_to_targets"):
        plan = _plan(entry.queries()[name](spark, SF_SMALL))
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_one_pass_operators_do_not_shuffle(spark):
    for name, python in (("op6_language_id", 1), ("op8_decontamination", 1), ("op9_token_counts", 1), ("op4_quality_rules", 0)):
        plan = _plan(entry.queries()[name](spark, SF_SMALL))
        tree = plan.split("\n\n")[0]
        assert "Exchange" not in tree and tree.count("ArrowEvalPython") == python


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, against a plain version of its decision."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r["doc_id"] for r in docs.collect()]
        assert len(after) == len(set(after)) and set(after) <= set(before)
        if name != "token_output":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        elif name == "near_duplicates":
            assert set(after) == {d for d, v in brute.near_duplicates(list(before.items())).items() if v[2]}
        elif name == "mixing":
            assert 0 < len(after) < len(before)
        elif name == "token_output":
            assert set(after) == set(before)
            from tokenizers import Tokenizer

            from tidewatch.llm.tokens import tokenizer_path

            lib, at = Tokenizer.from_file(tokenizer_path()), 0
            for r in docs.orderBy("doc_id").collect():
                ids = [*lib.encode(before[r["doc_id"]], add_special_tokens=False).ids, 2]
                crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
                assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc)
                at += len(ids)


def test_pipeline_run_against_plain_decisions(spark):
    """run() as a whole: the later stages decided in plain Python from what language ID keeps."""
    from tokenizers import Tokenizer

    from tidewatch.llm import langid
    from tidewatch.llm.tokens import tokenizer_path

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in langid.known(docs).collect()}
    kept = {d for d, v in brute.near_duplicates([(d, r["text"]) for d, r in rows.items()]).items() if v[2]}
    kept = {d for d in kept if not brute.contaminated(rows[d]["text"], items)}
    kept = brute.drawn([(d, rows[d]["text"], rows[d]["source"], rows[d]["lang"]) for d in sorted(kept)])
    lib, at = Tokenizer.from_file(tokenizer_path()), 0
    got = corpus_pipeline.run(spark, SF_SMALL).orderBy("doc_id").collect()
    assert {r["doc_id"] for r in got} == kept and len(got) == len(kept) > 0
    for r in got:
        ids = [*lib.encode(rows[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, clashing columns; and no documents at all."""
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang = 'en'").first()["text"]
    rows = [(k, f"{text} number {k} " + " ".join(f"w{k}x{j}" for j in range(60)), "en", "s", k, "mine") for k in range(40)]
    rows += [rows[3], (None, text + " without a name", "en", "s", 1, "mine"), (50, None, "en", None, None, None), (51, "", None, "s", 1, "mine")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string"
    for name, some in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in some} and (not some) == (not got)
