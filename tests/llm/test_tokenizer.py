import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from docloom.llm import queries, tokenizer  # noqa: E402

TEXTS = ["", None, "a", " ", "\n\n \t x", "Hello world", "<|endoftext|> x<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", "ab" * 500, "don't we'll I'd", "naïve café — “quoted”", "日本語のテキストと漢字", "привет мир", "🙂🇮🇴 emoji", "a" * 100_000, "x\u0000y�", " leading", "trailing  ", "123 4567 ٣٤٥", "é" * 50, "\r\n\r\n"]


@pytest.fixture(scope="module")
def known():
    t = tokenizers.Tokenizer.from_file(tokenizer.vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.PairIndexEncoder()


def split(encoder, texts):
    ids, at = encoder.texts(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_odd_texts(encoder, known):
    assert split(encoder, TEXTS) == known(TEXTS)
    assert split(encoder, []) == [] and split(encoder, [None]) == [[]]


def test_random_bytes_and_runs(encoder, known):
    rng = random.Random(1)
    alphabets = ["ab", "aA ", "the in", "éàü ", "漢字かな", "0123 ", "".join(map(chr, range(32, 1000)))]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(200))) for a in alphabets for _ in range(60)]
    assert split(encoder, texts) == known(texts)


def test_stretches_cover_all():
    texts = ["x" * n for n in (5, 0, 7, 20, 1)] + [None]
    parts = list(tokenizer.stretches(texts, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
    assert list(tokenizer.stretches([])) == []


def test_all_documents(spark, data, known):
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    want = known([r.text for r in docs])
    assert all(got[r.doc_id] == w for r, w in zip(docs, want))


def test_repeats_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3), (1, "a b", None, 3), (None, None, "s", 3)], "k1 int, text string, value string, ids int")
    got = tokenizer.encode_column(df, "k1", "text", keep=["value"]).collect()
    assert sorted((r.k1 or 0, r.value or "", r.ids) for r in got) == [(0, "s", []), (1, "", [64, 275]), (1, "s", [64, 275])]
    assert [r.n_tokens for r in tokenizer.encode_column(df, "k1", "text", counts_only=True).orderBy("k1").collect()] == [0, 2, 2]
    assert tokenizer.encode_column(df.limit(0), "k1", "text").count() == 0


def test_other_vocabularies(tmp_path, encoder, known, spark):
    """The pattern of a file is used, one that isn't built here is refused, and the setting of the session names the folder."""
    import json

    file = json.load(open(tokenizer.vocabulary(), encoding="utf-8"))
    own = file | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\p{N}|[a-z]+"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
    (tmp_path / tokenizer.DEFAULT).write_text(json.dumps(own))
    path = f"{tmp_path}/{tokenizer.DEFAULT}"
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["", "hello World 123 — naïve", "a" * 40, "日本語 x9"]
    assert split(tokenizer.PairIndexEncoder(path), texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, t string")
    spark.conf.set(tokenizer.SETTING, str(tmp_path))
    try:
        assert [list(r.ids) for r in tokenizer.encode_column(df, "k", "t").orderBy("k").collect()] == split(tokenizer.PairIndexEncoder(path), texts)
    finally:
        spark.conf.unset(tokenizer.SETTING)
    for bad in (file | {"normalizer": {"type": "NFC"}}, file | {"pre_tokenizer": {"type": "Whitespace"}}, file | {"model": file["model"] | {"end_of_word_suffix": "</w>"}}):
        with pytest.raises(ValueError):
            tokenizer.word_pattern(bad)
