"""Each stage against the operator's brute-force version, on its own input."""

import random

import corpus_pipeline
from test_classifiers import prose, toxic_rows
from test_decontaminate import brute_kept
from test_simhash import brute_components, brute_print
from test_tokens import PATH, want_digests
from tokenizers import Tokenizer


def make(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = toxic_rows(rng, 700)
    items = [(k, prose(rng, "en", 20)) for k in range(8)]
    for k in range(6):
        rows.append((2000 + k, f"{prose(rng, 'en', 30)} {items[k][1]} {prose(rng, 'en', 9)} {items[k + 1][1]}"))
    for k in range(5):  # one item alone, whole or in part, in short and long documents
        passage = " ".join(items[k][1].split()[k : k + 8 + 3 * k])
        rows.append((2100 + k, f"{prose(rng, 'en', 9 + 100 * k)} {passage} {prose(rng, 'en', 30)}"))
    items += [(90, "xq zq"), (91, "qqx")]
    rows += [(2200, f"{prose(rng, 'en', 30)} xq zq {prose(rng, 'en', 9)}"), (2201, f"{prose(rng, 'en', 40)} xq zq {prose(rng, 'en', 9)} qqx")]
    rows += [(3000 + k, rows[k][1]) for k in range(40)] + [(4000, None), (4001, "")]
    docs = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in rows]
    for name, data, ddl in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, ddl).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), items


def test_stages(spark, tmp_path):
    sf_dir, items = make(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == columns
            path = f"{tmp_path}/out-{len(seen)}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            after = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":
            bad = {i for i, t in before if t and {"idiot", "scum", "moron"} & set(t.split())}
            gone = {i for i, _ in before} - set(after)
            assert gone <= bad and len(gone) > 0.9 * len(bad)
        elif name == "near duplicates":
            assert after == sorted(set(brute_components([(i, brute_print(t)) for i, t in before])))
        elif name == "benchmark":
            assert sorted(map(str, after)) == brute_kept(before, items)
            assert {i for i, _ in before} - set(after) == {*range(2000, 2006), *range(2100, 2105), 2201}
        elif name == "mix":
            assert set(after) <= {i for i, _ in before} and max(map(after.count, after)) <= 3
        else:
            want = sorted(x[2:] for x in want_digests(before, Tokenizer.from_file(PATH)))
            assert sorted(tuple(r)[2:] for r in out.collect()) == want
        seen.append(name)
    assert len(seen) == 5


def test_run_is_the_stages_in_turn(spark, tmp_path):
    sf_dir, _ = make(spark, tmp_path)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    """Nulls, ties, repeated rows and columns with the stages' own names; then no rows at all."""
    sf_dir, items = make(spark, tmp_path)
    extra = ("toxic_score", "near_fp", "near_row", "n_words", "found", "full", "hit_bits", "mix_copy", "key", "label", "tie", "row")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 or doc_id > 2000")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some null id", None, None, 3), (5, "five", "en", "s1", 4), (5, "five", "en", "s1", 4), (5, None, "en", None, None)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", *[f"'{c}' as {c}" for c in extra])
    none = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, empty = stage(spark, docs, sf_dir), stage(spark, none, sf_dir)
        assert empty.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns == empty.columns
            out.write.parquet(f"{tmp_path}/odd-{k}")
            docs = spark.read.parquet(f"{tmp_path}/odd-{k}")
            kept = docs.collect()
            assert kept and all(r[c] == c for r in kept for c in extra)
    assert out.count() == docs.count()
