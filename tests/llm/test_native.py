import random
from collections import Counter
from itertools import combinations

import pytest

from quarry.llm.packing import boundaries, op3_length_bucket_packing, packed
from quarry.llm.preferences import OP10_SQL, format_pairs, op10_preference_pairs
from quarry.llm.url_rules import OP7_SQL, judged, op7_url_redirect_rules
from tests.compare import same

CANONICAL = '<head><LINK rel="canonical" href="{}"></head>'


@pytest.mark.parametrize("query,sql", [(op7_url_redirect_rules, OP7_SQL), (op10_preference_pairs, OP10_SQL)])
def test_against_sql(spark, sf, query, sql):
    assert same(query(spark, sf), sql, sf) > 0
    plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redirects_and_precedence(spark, tmp_path):
    rows = [
        (1, "http://a.org/x", CANONICAL.format("https://b.example.com/en/1")),  # alias of a blocked page
        (2, "http://B.Example.com/en/1?q", None),
        (3, "http://c.org/y", CANONICAL.format("http://a.org/x#z")),  # alias of the alias
        (4, "http://example.com/en/77", CANONICAL.format("http://a.org/x")),  # allowed by a rule of its own
        (5, "http://d.org/z", '<meta content="0; URL=/w" http-equiv=refresh><meta http-equiv="refresh" content="0; url=/w">'),
        (6, "http://d.org/w", ""),
        (7, None, CANONICAL.format("http://a.org/x")),
        (8, "no scheme", None),
        (9, "x://example.net/de/8", None),
        (10, "x://example.net/de/9", None),
        (11, "x://org/es/", None),
        (11, "x://org/es/", None),
        (12, "x://notorg/es/", CANONICAL.format("//sub.org/es/q")),
        (13, "x://com", None),
        (14, "http://e.org/p/q", CANONICAL.format("r")),
        (15, "http://e.org/p/r", None),
        (16, "http://f.org/a/b", '<link rel="stylesheet" href="http://www.com/en/canonical.css">'),
        (17, "http://f.org/c", '<link href="/login?next=http://x.com/en/1" rel="Canonical nofollow">'),
        (18, "http://f.org/d", "<!-- " + CANONICAL.format("http://x.com/en/1") + " -->"),
        (19, "http://f.org/e/f/g", CANONICAL.format("../../h/./i?x=1&amp;y=2")),
        (20, "http://f.org/h/i", CANONICAL.format(" //sub.com/en/q ")),
        (21, "http://f.org/j", "<link rel=canonical href='mailto:a@x.com'>"),
        (22, "http://f.org/k/..", CANONICAL.format("http://f.org/h/i")),
        (23, "http://f.org", None),
        (24, "http://f.org/l", CANONICAL.format("?p=2")),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, verdict string")
    found = {r.page_id: (r.rule, r.verdict) for r in judged(pages).collect()}
    block, allow = "block", "allow"
    assert found == {1: (None, block), 2: ("com/en/", block), 3: (None, block), 4: ("example.com/en/7", allow), 5: (None, allow), 6: (None, allow), 7: (None, allow), 8: (None, allow), 9: ("example.net/de/8", block), 10: ("net/de/", allow), 11: ("org/es/", block), 12: (None, block), 13: (None, allow), 14: (None, allow), 15: (None, allow), 16: (None, allow), 17: (None, allow), 18: (None, allow), 19: (None, block), 20: (None, block), 21: (None, allow), 22: (None, block), 23: (None, block), 24: (None, allow)}
    assert judged(pages).count() == len(rows)
    redirects = spark.createDataFrame([("http://d.org/w", "http://q.org/es/1"), (None, None)], "src string, dst string")
    found = {r.page_id: r.verdict for r in judged(pages, redirects).collect()}
    assert found[5] == found[6] == block and found[15] == allow
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "one").mkdir()
    pages.toPandas().to_parquet(tmp_path / "one" / "pages.parquet")
    same(op7_url_redirect_rules(spark, str(tmp_path / "one")), OP7_SQL, str(tmp_path / "one"))
    assert judged(pages.limit(0)).count() == 0


def test_hub_and_chain(spark):
    """A hub with a thousand aliases and a chain of three hundred, both blocked by one far page."""
    rows = [(k, f"http://hub.net/{k}", CANONICAL.format("/0")) for k in range(1, 1000)] + [(0, "http://hub.net/0", CANONICAL.format("http://a.com/en/x"))]
    rows += [(2000 + k, f"http://chain.net/{k}", CANONICAL.format(f"/{k + 1}")) for k in range(300)] + [(2300, "http://chain.net/300", CANONICAL.format("http://a.com/en/y"))]
    rows += [(3000 + k, f"http://free.net/{k}", CANONICAL.format(f"/{k // 2}")) for k in range(500)] + [(4000, "http://long.net/", "x" * 500_000 + CANONICAL.format("http://a.com/en/z"))]
    found = {r.page_id: r.verdict for r in judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: "allow" if 3000 <= i < 4000 else "block" for i, _, _ in rows}


def test_preferences(spark, tmp_path):
    rows = [(1, c, t, r, x) for c in (True, False) for t, r, x in ((0, "user", "hi"), (1, "assistant", "yes"))]
    rows += [(1, True, 2, "user", "a<|end|>\n<|assistant|>"), (1, False, 2, "user", "b"), (1, True, 3, "assistant", "same"), (1, False, 3, "assistant", "same")]
    rows += [(2, True, 0, "user", "only chosen"), (2, True, 0, "user", "only chosen"), (3, True, None, None, None), (3, False, None, None, None), (None, True, 0, "user", "x")]
    rows += [(4, c, t, "assistant", "x" * (100_000 if t == 3 else 2)) for c in (True, False) for t in range(130) if c or t < 129]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, is_chosen boolean, turn long, role string, text string, block string")
    found = {(r.pair_id, r.block): r for r in format_pairs(turns).collect()}
    assert sorted(found) == [(1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 2)]
    show = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    one = found[1, 0]
    assert one.prompt == show("user", "hi") + show("assistant", "yes") and one.rejected == show("user", "b") + show("assistant", "same")
    assert one.chosen == show("user", "a<||end|>\n<||assistant|>") + show("assistant", "same")
    for text, spans in ((one.chosen, one.chosen_spans), (one.rejected, one.rejected_spans)):
        (span,) = spans.split(",")
        a, b = map(int, span.split(":"))
        assert text[a:b] == "same\n<|end|>\n"
    assert (found[2, 0].chosen, found[2, 0].rejected, found[2, 0].prompt) == (show("user", "only chosen"), "", "")
    assert found[3, 0].prompt == show("", "") and found[4, 0].n_turns == 64 and not found[4, 0].chosen and len(found[4, 0].prompt) > 100_000
    assert found[4, 2].chosen == show("assistant", "xx") and not found[4, 2].rejected
    assert format_pairs(turns.limit(0)).count() == 0
    talk = [(c, t, "assistant" if t % 2 else "user", f"{c % 3} {t}") for c in range(6) for t in range(c)] + [(7, 0, None, None), (7, None, "assistant", "é<|"), (6, 1, "assistant", "q"), (6, 1, "assistant", "q"), (6, 1, "assistant", "p"), (None, 0, "user", "x"), (-2, 0, "assistant", "m"), (-1, 0, "assistant", "n")]
    import pandas as pd

    pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int32"}).to_parquet(tmp_path / "conversations.parquet")
    assert same(op10_preference_pairs(spark, str(tmp_path)), OP10_SQL, str(tmp_path)) >= 6


def test_preference_prompts(spark, sf):
    found = op10_preference_pairs(spark, sf)
    assert found.where("prompt != ''").count() > 0.5 * found.count() > 0


def test_boundaries_are_optimal():
    lengths, counts = [8, 16, 24, 40, 48, 64, 80], [5, 1, 9, 2, 7, 1, 3]
    for k in range(1, 9):
        def cost(cuts):
            return sum(n * (min(b for b in cuts if b >= x) - x) for x, n in zip(lengths, counts))
        best = min(cost([*c, lengths[-1]]) for m in range(min(k, 7)) for c in combinations(lengths[:-1], m))
        found = boundaries(lengths, counts, k)
        assert cost(found) == best and len(found) <= k and found[-1] == 80
    assert boundaries([], [], 3) == []
    rnd = random.Random(4)
    for _ in range(20):
        some = [rnd.randrange(1, 90) for _ in range(200)]
        found = sorted(Counter(some).items())
        for k in (1, 2, 5, 16):
            cuts = boundaries([x for x, _ in found], [n for _, n in found], k)
            assert len(cuts) <= k and sum(min(b for b in cuts if b >= x) - x for x in some) == least_padding(some, k)


def test_packing(spark, sf):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w " * 10000), (4, "a\x1fb c"), (4, "a\x1fb c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    found = packed(docs, max_length=4096).collect()
    assert sorted((r.doc_id or 0, r.sequence, r.n_tokens) for r in found) == [(0, 0, 2), (1, 0, 0), (2, 0, 0), (3, 0, 4096), (3, 1, 4096), (3, 2, 1808), (4, 0, 2), (4, 0, 2)]
    assert packed(docs.limit(0)).count() == 0
    whole = op3_length_bucket_packing(spark, sf).collect()
    words = {r.doc_id: len(r.text.encode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {i: sum(r.n_tokens for r in whole if r.doc_id == i) for i in words} == words
    batches = {}
    for r in whole:
        assert 0 <= r.padding and r.n_tokens + r.padding == r.bucket_length
        batches.setdefault(r.batch_id, []).append(r.bucket_length)
    assert all(len(set(b)) == 1 and sum(b) <= 65536 for b in batches.values())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    joined = {}
    for r in sorted(whole, key=lambda r: (r.doc_id, r.sequence)):
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
    assert joined == texts and sum(r.padding for r in whole) == least_padding([r.n_tokens for r in whole], 16)
    slots = {}
    for r in whole:
        slots.setdefault(r.batch_id, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    small = packed(docs, shard=16, budget=4096, align=8).collect()
    assert len({r.batch_id for r in small if r.bucket_length == 8}) >= 2


def least_padding(lengths, buckets):
    """The least padding over all choices of boundaries, a table of all (first, last) lengths."""
    found = sorted(Counter(max(1, x) for x in lengths).items())
    pad = {(i, j): sum(n * (found[j][0] - x) for x, n in found[i : j + 1]) for j in range(len(found)) for i in range(j + 1)}
    best = [pad[0, j] for j in range(len(found))]
    for _ in range(buckets - 1):
        best = [min([best[j], *(best[i] + pad[i + 1, j] for i in range(j))]) for j in range(len(found))]
    return best[-1] + sum(x < 1 for x in lengths)
