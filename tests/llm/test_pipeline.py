import random

import corpus_pipeline
from quarry.llm import similar
from quarry.llm.packing import packed
from quarry.llm.similar import similar_groups
from tests.llm import test_quality, test_suffix_array


def shingles(text, k=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, sf)
    want = [r[0] for r in test_quality.brute([(r.doc_id, r.text, r.lang) for r in rows.values()]) if r[-1]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    one = stages["near_dedup"](spark, kept, sf)
    stay = {r.doc_id for r in one.collect()}
    sets = {i: shingles(rows[i].text) for i in want}
    groups = {r.doc_id: r.component_id for r in similar_groups(kept).collect()}
    assert stay == {i for i, c in groups.items() if i == c} and one.columns == docs.columns
    # A text that goes has a similarity of 0.8 or more to one of its group; such texts are found.
    near = lost = 0
    for i in want:
        for j in want:
            if j < i and sets[i] & sets[j]:
                alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                near += alike >= 0.8
                lost += alike >= 0.8 and groups[i] != groups[j]
    assert near and not lost
    for i in want:
        if groups[i] != i:
            assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in want if j != i and groups[j] == groups[i]) >= 0.8
    clean = stages["suffix_array_dedup"](spark, one, sf)
    assert clean.columns == docs.columns
    removed = {r[0]: (r[1], r[2]) for r in test_suffix_array.brute([(i, rows[i].text) for i in stay])}
    for r in clean.collect():
        n, gone = removed[r.doc_id]
        assert len(r.text.encode()) <= n - gone and (gone or r.text == rows[r.doc_id].text) and r.n_chars == len(r.text)
    assert corpus_pipeline.run(spark, sf).count() == packed(clean).count()


def test_common_shingles_chunks_and_budgets(spark, monkeypatch):
    """Near copies in large groups, a passage that many texts share, equal and empty texts; small chunks and budgets."""
    monkeypatch.setattr(similar, "SMALL", 5)
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    base, line, texts = words(120), words(12), []
    for _ in range(40):
        copy = list(base)
        for _ in range(rnd.randrange(5)):
            copy[rnd.randrange(120)] = "x"
        texts += [" ".join(copy), " ".join(line + words(60))]
    short = words(9)
    texts += [" ".join(short), " ".join(short[:8]), "", None, texts[0], " ".join(words(4))]
    docs = spark.createDataFrame([*((i, t, "c") for i, t in enumerate(texts)), (None, texts[1], "c")], "doc_id long, text string, component string")
    sets = [shingles(t or "") if (t or "").split() else set() for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(i for i, q in enumerate(root) if q == r) for r in root}
    found = {r.doc_id: r.component_id for r in similar.similar_groups(docs, chunk=7).collect()}
    assert found == {**{i: least[r] for i, r in enumerate(root)}, None: 1}


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, equal ids, clashing names and an empty table through the whole pipeline."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, n_removed string, rest string, part string, text_2 string"
    rnd = random.Random(6)
    prose = lambda n: " ".join(rnd.choice(("the", "of", "and", "to", "in", "that", "is", "was", "he", "for")) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(3, 9))) for _ in range(n))
    texts = [prose(200) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en"), (100, texts[0], "en"), (1, prose(200), "en"), (None, prose(200), None), (None, prose(200), None), (101, None, None), (102, "", "en"), (103, " \n", None), (104, prose(60_000), "en"), (105, "x" * 300_000, "en")]
    docs = spark.createDataFrame([(i, t, lang, None, None, *["x"] * 6) for i, t, lang in rows], schema)
    docs.write.parquet(str(tmp_path / "some/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    stay = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stay = stage(spark, stay, str(tmp_path / "some"))
        assert stay.schema.names == docs.schema.names, name
    ids = sorted((r.doc_id for r in stay.collect()), key=str)
    assert ids == sorted([*range(30), 1, None, None, 104], key=str)
    found = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted({r.doc_id for r in found}, key=str) == sorted(set(ids), key=str)
    assert sum(r.n_tokens for r in found) == 33 * 200 + 60_000
