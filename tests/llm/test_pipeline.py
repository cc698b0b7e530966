import corpus_pipeline
from tests.llm.helpers import prose
from tests.llm.test_decontaminate import brute
from tests.llm.test_langid import text
from tests.llm.test_near_copies import changed, groups_of
from twinlens.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rows = [(i, text("en" if i % 2 else "de", i, 80) + " " + prose(i, 60), "en" if i % 2 else "de") for i in range(30)]
    rows += [(100 + i, rows[i][1], "en") for i in range(6)] + [(100, rows[0][1], "en")]
    rows += [(200 + i, changed(rows[10][1], i, 2), "en") for i in range(4)]
    rows += [(300, None, "en"), (301, "1234 !!", None), (302, "", "de"), (None, "eine bestellung mit versand", None)]
    passage = prose(77, 40, 5000)
    rows += [(400, "intro text for it " + passage, "en"), (401, prose(5, 900) + " " + " ".join(passage.split()[:13]), "en")]
    return [(i, t, lang, "s", 0) for i, t, lang in rows], passage


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    best = {}
    for i, t in left:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    left = [(None if i < 0 else i, t) for t, i in best.items()]
    group = groups_of([(str(i), t) for i, t in left])
    least = {}
    for i, t in left:
        least[group[t]] = min(least.get(group[t], 10**9), -1 if i is None else i)
    left = [(i, t) for i, t in left if least[group[t]] == (-1 if i is None else i)]
    want = sorted(-1 if i is None else i for i, t in left if not brute(t, [(1, passage)])[3])
    assert 400 not in want and 401 in want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == want
    assert all(r["n_pieces"] == len(r["ids"]) > 0 for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, passage = documents()
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_of_one_id_are_decided_by_their_own_texts(spark, tmp_path):
    passage = prose(77, 40, 5000)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole, near = prose(600, 80, 5000), prose(601, 200, 5000)
    dropped = {"language": "1234 !!", "exact copies": whole, "near copies": changed(near, 1, 2), "decontamination": "intro text " + passage}
    kept = {"exact copies": (900, whole), "near copies": (-5, near)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for shared in (None, 4):  # an id whose text the language model may learn from
            # Of near copies the least id stays, and a null id is below every other.
            other = kept.get(name) if name != "near copies" or shared else (None, near)
            rows = [(shared, "a clean text with the words of its own " + prose(602, 60, 5000)), (shared, dropped[name]), *([other] if other else [])]
            docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
            got = [(r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()]
            if name == "near copies" and shared is None:
                assert rows[0] in got and len(got) == 2  # one of two null ids
            else:
                assert sorted(got, key=repr) == sorted([r for r in rows if r[1] != dropped[name] or r[0] == 900], key=repr), (name, shared)


def test_a_corpus_without_labels_keeps_its_texts(spark, tmp_path):
    rows = [(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "слово", None), (None, "", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], COLUMNS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, docs, str(tmp_path)).collect()) == [1, 4]


def test_columns_of_any_name_come_through_every_stage(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["digest", "dropped_id", "dropped_digest", "path", "kept"]
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], COLUMNS + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and 0 < got.count() < len(rows), name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names), name


def test_every_numbered_query_is_there():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
