import hashlib
import random

import sentencepiece

from quarry.llm.piece_bpe import Codec, default_model, detokenized, digests, tokenized

MODEL = sentencepiece.SentencePieceProcessor(model_file=default_model())
ODD = ["", " ", "   ", "a", "\n", "\n\n a\tb", "▁", "▁x ▁ y", "<s> </s><unk><0x41>", "éß ñ 東京 🙂🙂 ​�", "aaaaaaaaaaaaaaaaa", "ababababab", "the" * 500, " " * 100 + "x" + " " * 33, "0123456789" * 30, "\u0000\x01", "е́ ё", "x" * 5000, "hahahahahahaha", "==========----------"]


def test_same_ids_as_the_library(spark, sf):
    rnd = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    chars = ["a", "b", "in", "the", " ", "  ", "▁", "\n", "é", "ing", "st", "tt", "x", "東", "🙂", ".", ",", "0"]
    texts += ODD + ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(rnd.choice(p) for _ in range(40)) for p in ("ab", "ao", "tion", "▁ ", "-=", "eses", "in", "\t\n", "0123", "стра") for _ in range(150)]
    codec = Codec(default_model())
    for text, own, ids in zip(texts, codec.encode(texts), MODEL.encode(texts, num_threads=1)):
        assert own == ids, text[:200]
        assert codec.decode(own) == MODEL.decode(ids)


def test_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (7, None), (7, None)]
    want = []
    for i, t in rows:
        ids = MODEL.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    assert sorted((tuple(r) for r in digests(docs).collect()), key=str) == sorted(want, key=str)
    assert digests(docs.limit(0)).count() == 0


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in detokenized(tokenized(docs)).collect()} == {tuple(r) for r in docs.collect()}


def test_runs_of_every_length():
    texts = [t for n in range(1, 131) for t in ("a" + " " * n + "b", " " * n, "a" * n, "a\n" + " " * n + "return x")]
    for text, own, ids in zip(texts, Codec(default_model()).encode(texts), MODEL.encode(texts, num_threads=1)):
        assert own == ids, text
