import random
import re

import pandas as pd
import pytest
import zstandard

from docloom.llm import mojibake, queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    df = pd.read_parquet(f"{DATA}/documents.parquet", columns=["doc_id", "lang", "text"])
    return df.astype(object).where(df.notna(), None)


@pytest.fixture(scope="module")
def model(spark):
    return mojibake.train(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text", "lang")


def read_as(text, written, read):
    raw = text.encode(written)
    return "".join(chr(b) if b < 128 else mojibake.letters_of(read)[b - 128] or chr(b) for b in raw)


def test_a_dictionary_for_each_language(model):
    assert set(model.dictionaries) == {*mojibake.LETTERS, *mojibake.SCRIPTS}
    assert all(len(d) <= mojibake.DICTIONARY_BYTES for d in model.dictionaries.values())


def test_garbled_copies_of_held_out_texts(spark, docs):
    """Texts the dictionaries were not trained on, read wrongly as a whole or in a sentence, are found and mostly restored.

    Documents of even ids train; those of odd ids are garbled, unless the same text is among the even ones.
    """
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = mojibake.train(table.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    trained = {t for i, t in zip(docs.doc_id, docs.text) if i % 2 == 0}
    rng, n, found, same = random.Random(4), 0, 0, 0
    for r in docs.itertuples():
        lang = mojibake.language(r.lang)
        if r.doc_id % 2 == 0 or r.text in trained or not r.text or lang is None or r.text.isascii() or model.restore(r.text, r.lang)[1]:
            continue
        parts = [p for line in r.text.split("\n") for p in mojibake.SENTENCE.findall(line) if not p.isascii() and len(p) > 8]
        if not parts:
            continue
        part = r.text if rng.random() < 0.5 else rng.choice(parts)
        bad = r.text.replace(part, read_as(part, "utf-8", rng.choice(["cp1252", "latin-1", "cp1251", "mac_roman", "cp850"])), 1)
        new, steps = model.restore(bad, r.lang)
        n, found, same = n + 1, found + bool(steps), same + (new == r.text)
    assert n > 150 and found >= 0.98 * n and same >= 0.9 * n


def test_single_bytes_read_wrongly(model, docs):
    for lang, written, read in (("ru", "koi8-r", "cp1252"), ("pl", "cp1250", "cp1252"), ("tr", "cp1254", "cp1252"), ("zh", "gb18030", "cp1252"), ("el", "cp1253", "cp1252"), ("cs", "iso8859-2", "cp1252")):
        own = [r.text for r in docs.itertuples() if mojibake.language(r.lang) == lang and r.text and len(r.text) > 200 and not model.restore(r.text, r.lang)[1]]
        sound = [t for t in own if t.encode(written, "ignore").decode(written) == t and sum(a != b for a, b in zip(t, read_as(t, written, read))) > 5]
        assert sound
        got = [model.restore(read_as(t, written, read), lang) for t in sound]
        assert sum(bool(s) for _, s in got) >= 0.9 * len(sound), lang


def test_passages_without_signs(model, docs):
    """Small Russian letters that became capitals; umlauts that became quotation marks, which any text may use."""
    sound = [(mojibake.language(r.lang), r.text) for r in docs.itertuples() if r.text and not r.text.isascii() and not model.restore(r.text, r.lang)[1]]
    for lang, written, read, letters in (("ru", "koi8-r", "cp1251", "[а-я]"), ("de", "cp850", "cp1252", "[äö]")):
        parts = {p.lower().replace("ü", "ue").replace("ß", "ss") for x, t in sound if x == lang for line in t.split("\n") for p in mojibake.SENTENCE.findall(line) if len(p) > 40}
        fit = sorted(p for p in parts if len(re.findall("[^\x00-\x7f]", p)) == len(re.findall(letters, p)) > 3)[:60]
        assert len(fit) > 20
        got = [model.restore(read_as(p, written, read), lang) for p in fit]
        assert sum(new == p for p, (new, _) in zip(fit, got)) >= 0.8 * len(fit), lang


@pytest.mark.parametrize(
    "text",
    [
        "When the bytes of ö are read wrongly they show up as Ã¶ on screen, a classic mistake.",
        "Старые письма порой начинались с «Ïðèâåò»: так выглядит слово «Привет» в чужой кодировке.",
        "The sign � (U+FFFD) marks a byte that could not be read.", "The sign � (U+FFFD) marks a lost byte, and a second � marks another.",
        "Lower case and Â plus Ã in one line, and SÃO RÃS as well.",
        "Plain text of ASCII &amp; entities &eacute;", "", None, "a" * 50_000, "née Çelik, naïve café", "\n\n", "��"[:1],
    ],
)
def test_sound_texts_stay(model, text):
    for lang in ("en", None, "zz", "ru"):
        assert model.restore(text, lang) == (text, [])


@pytest.mark.parametrize(
    "text,lang,want",
    [
        ("Home Â· News Â· Archive", "en", "Home · News · Archive"), ("KÃ¶nnen auf grÃ¶Ã\x9fer", "de", "Können auf größer"), ("Guides Ã‚Â· Archive Ã‚Â· Basket", "en", "Guides · Archive · Basket"),
        ("tonham at &acirc;&euro;&oelig;that it", "en", "tonham at “that it"), ("ÐŸÐ¾Ð¼Ð¾Ñ‰ÑŒ | Ð’Ð¾Ð¹Ñ‚Ð¸", "ru", "Помощь | Войти"),
    ],
)
def test_known_chains(model, text, lang, want):
    new, steps = model.restore(text, lang)
    assert new == want and steps


def test_lost_bytes_are_found_but_not_restored(model):
    new, steps = model.restore("S��eci�n en r�atoci�n", "es")
    assert steps == ["?"] and new == "S��eci�n en r�atoci�n"


def test_losses_take_more_bytes_to_show_than_to_state(model):
    for text, lang in (("использует файлы cookie. �������", "ru"), ("�ber uns � Anmelden � Warenkorb � Startseite", "de"), ("Wir k�nnen auf gr��er", "de"), ("今天�气很好，我�去公园�步吧。", "zh")):
        assert model.restore(text, lang) == (text, ["?"])


def test_references_outside_a_garbled_passage_stay(model):
    text = "Write &lt;b&gt; and &amp;amp; for bold.\nHome &Acirc;&middot; News &Acirc;&middot; Archive\nCaf&eacute; &copy; 2020"
    new, steps = model.restore(text, "en")
    assert new == "Write &lt;b&gt; and &amp;amp; for bold.\nHome · News · Archive\nCaf&eacute; &copy; 2020" and steps[0] == "html"
    whole, steps = model.restore("tonham at &acirc;&euro;&oelig;that &lt;i&gt; it", "en")
    assert whole == "tonham at “that &lt;i&gt; it" and steps


@pytest.mark.parametrize("lang,written,read", [("ru", "cp1251", "gbk"), ("el", "cp1253", "gbk"), ("ja", "cp932", "gbk"), ("zh", "gbk", "cp1251"), ("ja", "euc_jp", "cp1252"), ("ru", "utf-8", "gb18030")])
def test_readings_in_east_asian_encodings(model, docs, lang, written, read):
    """Texts whose bytes happen to be whole characters of the wrong encoding, so that nothing was lost."""
    fit = {}
    for r in docs.itertuples():
        if mojibake.language(r.lang) == lang and r.text and not model.restore(r.text, r.lang)[1]:
            for part in (p.strip() for line in r.text.split("\n") for p in mojibake.SENTENCE.findall(line) if len(p) > 12):
                words = part.split(" ")
                for k in range(len(words)):
                    piece = " ".join(words[k:])
                    try:
                        bad = piece.encode(written).decode(read) if read[0] == "g" else read_as(piece, written, read)
                        if bad != piece and len(piece) > 12 and mojibake.to_bytes(bad, read) == piece.encode(written):
                            fit[piece] = bad
                            break
                    except UnicodeError:
                        pass
    fit = sorted(fit.items())
    fit = [(" ".join(x for x, _ in fit[k : k + 4]), " ".join(y for _, y in fit[k : k + 4])) for k in range(0, min(len(fit), 160) - 3, 4)]
    assert len(fit) > 5
    got = [model.restore(bad, lang)[0] == piece for piece, bad in fit]
    assert sum(got) >= 0.8 * len(fit)


def test_other_readings_save_no_more_than_the_reach(model, docs):
    """Sentences read wrongly in any two encodings, with dictionaries of their own and of other languages."""
    rng, seen = random.Random(9), 0
    for r in docs.itertuples():
        lang = mojibake.language(r.lang)
        for part in mojibake.SENTENCE.findall((r.text or "")[:2000]) if lang in mojibake.LETTERS else ():
            k = sum(c > "\x7f" for c in part)
            if 0 < k < 8:
                try:
                    read, written = rng.choice(mojibake.PAIRS)
                    bad = part.encode(written).decode(read)
                except UnicodeError:
                    continue
                for x in (lang, rng.choice(sorted(model.dictionaries))):
                    seen += 1
                    assert abs(model.size(bad, x) - model.size(part, x)) <= mojibake.BASE_REACH + mojibake.REACH * k
    assert seen > 1000


def test_long_garbled_text(model):
    text = "Können auf größer werden. " * 4000
    assert model.restore(read_as(text, "utf-8", "cp1252"), "de")[0] == text


def test_many_steps(model):
    for text, lang in (("a café in town", "en"), ("Search this site and the café near it", "fr")):
        bad = text
        for _ in range(5):
            bad = read_as(bad, "utf-8", "cp1252")
        assert model.restore(bad, lang)[0] == text


def test_rows_and_empty_tables(spark, model):
    df = spark.createDataFrame([(1, "Home Â· News", "en", "x"), (1, "Home Â· News", "en", None), (2, None, None, "k"), (3, "", "en", "k")], "k int, t string, l string, restored string")
    got = mojibake.restore_texts(df, "k", "t", "l", model).collect()
    assert [(r.k, r.restored) for r in got] == [(1, "Home · News")] * 2
    none = df.limit(0)
    assert mojibake.restore_texts(none, "k", "t", "l").count() == 0


def test_documents(spark, data):
    rows = queries.p10_restored(spark, data).collect()
    assert queries.p10_found(spark, data).columns == ["doc_id"]
    assert 0 < len(rows) < 30 and len({r.doc_id for r in rows}) == len(rows)


def test_what_is_ruled_out_early_cannot_be(model, docs, monkeypatch):
    """Readings ruled out by runs, and shapes found by their rarer part, are those that whole texts tell."""
    wide, called, raws = list(mojibake.WRITTEN_WIDE), [], 0
    texts = [r.text[:400] for r in docs.itertuples() if r.text and not r.text.isascii()][:600]
    texts += [read_as(t, "utf-8", read) for t in texts[:100] for read in ("cp1252", "cp1251", "mac_roman")]
    for t in texts:
        assert mojibake.misshapen(t) == bool(mojibake.SHAPES.search(t))
        own = mojibake.shared("".join(sorted({c for c in t if c > "\x7f"})))
        bad = mojibake.unreadable(t, own.wide_reads)
        for i in own.reads:
            raw = mojibake.to_bytes(t, mojibake.READ[i])
            one = re.search(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}", raw)
            assert (one and one.span()) == ((m := mojibake.UTF8.search(raw)) and m.span()) and (own.utf8 >> i & 1 or not one)
            for j, written in enumerate(wide):
                raws += 1
                if bad >> i * len(wide) + j & 1:
                    with pytest.raises(UnicodeDecodeError):
                        raw.decode(written)
    whole = mojibake.decoded
    monkeypatch.setattr(mojibake, "decoded", lambda *x: called.append(x) or whole(*x))
    for t in texts:
        model.candidates(t, "en")
    assert 0 < len(called) < raws / 3


def test_shortcuts_give_what_the_plain_rules_give(model, docs):
    texts = [r.text[:600] for r in docs.itertuples() if r.text and not r.text.isascii()][:400]
    texts += [read_as(t, "utf-8", read) for t in texts[:60] for read in ("cp1252", "cp1251", "mac_roman", "cp866")]
    texts += [t.replace("\xa0", " ") for t in texts[-240:]] + ["é", "é9é9", "\né", "éa\nñ", "ÐŸÐ ÐŸÐ°Ð"]
    ruled = sandwiches = 0
    for t in texts:
        high = mojibake.without_ascii(t)
        chars = "".join(sorted(set(high)))
        own = mojibake.shared(chars)
        assert mojibake.neighbours(t) == "\n".join(sorted({t[max(0, m.start() - 1) : m.end() + 1] for m in re.finditer("[^\x00-\x7f]+", t)}))
        assert bool(mojibake.LONG_RUN.search(t)) == bool(re.search("[^\x00-\x7f]{2}|[^\x00-\x7f][0-9][^\x00-\x7f][0-9]", t))
        assert all(mojibake.aliens(high, chars, x) == len(mojibake.foreign(x).findall(t)) for x in model.dictionaries)
        side, bad = mojibake.side_by_side(t), mojibake.unreadable(t, own.wide_reads, True)
        for i in own.reads:
            raw = mojibake.to_bytes(t, mojibake.READ[i])
            for j, written in enumerate(mojibake.WRITTEN_WIDE):
                new = mojibake.decoded(raw, written, False) if bad >> i * len(mojibake.WRITTEN_WIDE) + j & 1 else None
                assert new is None or re.search("[a-zß-ÿ][\u3040-\u30ff\u4e00-\u9fff][a-zß-ÿ]", new)
                sandwiches += new is not None
            assert side >> i & 1 or not mojibake.UTF8.search(raw)
            sound = mojibake.UTF8.findall(raw)
            mended, n = re.subn(rb"([\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]) ", b"\\1\xa0", raw)
            near = mended if n * 4 <= len(sound) else raw
            few = len(re.findall(rb"[\x80-\xff]", mojibake.UTF8.sub(b"", near))) * 8 <= len(mojibake.UTF8.findall(near))
            try:
                want = raw.decode() if sound else None
            except UnicodeDecodeError:
                want = near.decode("utf-8", "replace") if few else None
            assert mojibake.from_utf8(raw) == want
        left = mojibake.unbroken(own.swaps, t)
        for i in mojibake.bits(own.swaps & ~left):
            read, written = mojibake.PAIRS[i]
            assert mojibake.SHAPES.search(mojibake.to_bytes(t, read).decode(written))
            ruled += 1
    assert ruled > 1000 and sandwiches > 100
    for x in model.dictionaries:
        assert all(model.size(w, x) >= mojibake.FRAME for t in texts[:100] for w in (t[:1], t[:3], t[:40])) and model.size(" ", x) == mojibake.FRAME


def test_no_work_on_readings_that_cannot_win(model, monkeypatch):
    """Of short texts whose readings cost more in steps than could be saved, these are not compressed."""
    sized, whole, candidates = [], zstandard.ZstdCompressor, mojibake.Restorer.candidates

    class Counted:
        def __init__(self, **args):
            self.of = whole(**args)

        def compress(self, raw):
            sized.append(raw.decode())
            return self.of.compress(raw)

    monkeypatch.setattr(mojibake.zstandard, "ZstdCompressor", Counted)
    fresh, options = mojibake.Restorer(model.dictionaries), []
    monkeypatch.setattr(mojibake.Restorer, "candidates", lambda *x: options.extend(got := candidates(*x)) or got)
    for word in ("“Menu”", "Über uns", "Ça va", "«Menú»", "£ 20", "– Home –"):
        assert fresh.chain(word, "en") == (word, [])
    assert options and len({*sized} & {x[0] for x in options}) < len(options) / 2
