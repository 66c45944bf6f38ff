"""Quality rules, BPE, packing, language and toxicity against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import time
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.llm import bpe, exact_dedup, language_id, lm_scoring, packing, quality_rules, queries, simhash, toxicity
from inkveil.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
CLASHING = "doc_id bigint, text string, row string, score string, kept string, found string, n_words string"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "r", "s", "k", "f", "n") for i, t in pairs], CLASHING)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "x y"), (5, "word " * 3000), (6, "no end " * 4), (6, "no end " * 4), (7, "a" * 30_000)]


def quality_model(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rng = random.Random(1)
    pairs = ODD + [(100 + i, "".join(rng.choice(["a ", "b ", "c", "\n", "\x0b", "| ", "é ", "\xa0"]) for _ in range(rng.randint(0, 120)))) for i in range(120)]
    got = quality_rules.quality(table(spark, pairs)).collect()
    assert len(got) == len(pairs)
    for r in got:
        want = quality_model(r["row"]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r["kept"] or not r["base_failed"])


def line_passes(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n, bars, low = len(words), len(re.findall("[|>»•·]", line)), line.lower()
    addresses = low.count("http://") + low.count("https://") + low.count("www.") if line.islower() else len(re.findall(r"https?://|www[.]", line))
    stock = any(x in low for x in quality_rules.BOILERPLATE) or re.search("(©|[(]c[)]|copyright) *(19|20)[0-9][0-9]", low)
    end = line.rstrip(" \t\n\x0b\x0c\r").rstrip("\"'”’»)]")
    return (
        any(c.isalnum() for c in line) and end.endswith(tuple(".!?…:;。！？"))
        and not len(re.findall(r"[#*$%&|<>]", line)) > 0.1 * len(line)
        and not (bars >= 3 and 4 * bars >= n) and not (addresses and 4 * addresses >= n)
        and not (n >= 5 and sum(a == b for a, b in zip(words, words[1:], strict=False)) > 0.3 * n)
        and not (stock and n < 30)
    )


LINES = [
    "This is a line of plain prose that ends as sentences do.", "Home | About | News | Contact | Help", "Home", "-----", "!!! ???", "=====", "A heading without an end",
    "He said \"so.\"", "Did it end (like this?)  ", "see https://example.com/a/b now.", "An address like https://example.com/a in the middle of enough other words does not harm.",
    "© 2024 Some Firm Ltd.", "Copyright 2019, all of us.", "Read more.", "word word word word word word.", "Signs ### *** $$$ %%%.", "短い文です。", "», so.", "1.",
    "A very long line of more than thirty words in which a site asks its readers to read more of what its authors wrote over the years, about one thing and then about another one again.",
]


def test_lines_fail_one_by_one(spark):
    rng = random.Random(7)
    pairs = [(i, "\n".join(rng.choice(LINES) + rng.choice(["", "", " x"]) for _ in range(rng.randint(1, 9)))) for i in range(150)] + [(900 + i, x) for i, x in enumerate(LINES)]
    df = table(spark, pairs)
    got = {r["row"]["doc_id"]: r for r in quality_rules.quality(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in quality_rules.clean(df).collect()}
    kept = set()
    for i, text in pairs:
        lines = text.split("\n")
        lost = sum(len(x.split()) for x in lines if not line_passes(x))
        assert clean[i] == "\n".join(x for x in lines if not x.strip() or line_passes(x)), text
        assert got[i]["kept"] == (not got[i]["base_failed"] and not lost > 0.5 * len(text.split())), text
        kept |= {i} if got[i]["kept"] else set()
    assert 10 < len(kept) < 140
    assert quality_rules.clean(df).schema == df.schema and quality_rules.quality(df).filter("kept").select("row.*").schema == df.schema
    assert quality_rules.quality(table(spark, [])).count() == 0
    sized = spark.createDataFrame([(1, "Gone\nThis stays.", 16)], "doc_id bigint, text string, n_chars bigint")
    assert quality_rules.clean(sized).first() == (1, "This stays.", 11)


def test_line_ends_are_judged_whole(spark):
    tails = ["\"", "\"" * 31, "\"" * 32, "’" * 40 + " " * 40, " " * 31, "\t" * 500, ")" * 200 + " x", "x" * 32, ""]
    lines = [x + sign + tail for x in ("These are words of some line", "短い文です") for sign in (".", "…", "") for tail in tails]
    lines += ["a b http c d e f g h.", "see www.a.b now.", "so | so > so • so.", "x x x x x y.", "xx x x xx x xx x.", "ab  a ab ab\t ab ab b."]
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean(table(spark, list(enumerate(lines)))).collect()}
    assert got == {i: x if line_passes(x) else "" for i, x in enumerate(lines)} and 10 < sum(map(bool, got.values())) < len(lines) - 10


def test_rules_cost_little_beside_a_split(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    rows = [(i, "\n".join(" ".join(rng.choices(names, k=60)) + "." for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1).selectExpr("*", "explode(sequence(1, 6)) AS copy").cache()
    assert df.count() == 240

    def cost(out):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            out.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    split = cost(df.select(F.size(quality_rules.words_of(F.col("text")))))
    ratio = cost(quality_rules.quality(df)) / split
    df.unpersist()
    assert ratio < 9, ratio


def test_a_long_run_does_not_slow_its_batch():
    class Memo(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    own = bpe.LibraryIds(tokenizer_path())
    own.memo = Memo()
    long = ["x" * 49, "Bücher" * 20 + "!", "<|" + "y\x00" * 30, "z" * 48]
    texts = ["some words, again and again " * 500, None, f"{long[0]} {long[1]} twice {long[0]}", f"{long[2]} {long[3]}"]
    want = [own.own.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [list(ids) for ids in own.encode(texts)] == want
    assert own.memo.asked < 100 and not own.memo.keys() & set(long[:3]) and long[3] in own.memo


def test_rules_stay_in_the_jvm(spark):
    plan = quality_rules.quality(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    sets = ["ab", "aeiourst", "éèüßñ aeñ", "İIΣσςśé ̧ŉ", "0123456789 ab²½Ⅷ", "'stremld   \x1c\x1f\x85\n\x00", "!?.,;:-%$#@*&", "日本語カナ한글", "😀👍🏽🇫🇷", "\U0001e900ꟋᲉ x", "<|endoftext|>", "ABCdé.,!"]
    for _ in range(n):
        letters = rng.choice(sets) + rng.choice(["", " ", "a"])
        yield "".join(rng.choice(letters) for _ in range(int(10 ** rng.uniform(0, 3)))) + rng.choice(["", "<|startoftext|>x"])


def test_transducer_equals_the_library(library):
    own, by_library = bpe.codec(tokenizer_path()), bpe.library_ids(tokenizer_path())
    texts = ["", *odd_texts(600), "thein" * 8000]
    for text, fast in zip(texts, by_library.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        ids = [i for part in own.encode_stream(text) for i in part]
        assert ids == want and list(fast) == want
        machine = bpe.Decoder(own)
        assert "".join(machine.push(array("I", ids[at : at + 7]))[1] for at in range(0, len(ids), 7)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50])
def test_runs_are_streamed_as_the_library_reads_them(library, monkeypatch, chunk):
    """Runs cut at every kind of place: inside contractions, marks, Hangul, words, specials."""
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    own = bpe.codec(tokenizer_path())
    texts = [t for t in odd_texts(400, chunk) if t.split()] + ["don't've!!'s'll'l'r'red''s'", "각각ᆨ한가", "é́é", "x<|endoftext|>y<|startoftext|>", "İΣσς'M'D"]
    for run in (max(re.split(f"{bpe.SPACE}+", t), key=len) for t in texts):
        ids = [i for part in own.stream(run, 0, len(run)) for i in part]
        assert ids == library.encode(run, add_special_tokens=False).ids, run


def test_long_runs_take_constant_memory(library):
    import tracemalloc

    own, by_library = bpe.codec(tokenizer_path()), bpe.library_ids(tokenizer_path())
    text = "some words then " + "theinéa'st1!日" * 40_000 + " and more"
    want = library.encode(text, add_special_tokens=False).ids
    assert [i for part in own.encode_stream(text) for i in part] == want and list(by_library.encode(["a", text, None])[1]) == want
    peaks = []
    for n in (20_000, 80_000):
        text = "theinéa'st1!日" * n
        tracemalloc.start()
        assert sum(map(len, own.encode_stream(text))) > n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 500_000


def test_window_is_bounded_and_lookahead_suffices():
    own = bpe.codec(tokenizer_path()).transducer
    assert 0 < own.lookahead < 1000
    rng = random.Random(3)
    word = "".join(rng.choice("theinrao") for _ in range(20_000))
    seen, ahead = 0, 0

    def letters():
        nonlocal seen
        for c in word:
            seen += 1
            yield c

    emitted = 0
    for i in own.word(letters()):
        emitted += len(next(t for t, k in own.vocab.items() if k == i).removesuffix("</w>")) if emitted < 400 else 0
        ahead = max(ahead, seen - emitted) if emitted < 400 else ahead
    assert ahead <= own.window + 1


def test_encode_then_decode_tables(spark):
    df = table(spark, [(1, "Hello, wörld! 42"), (2, None), (3, "")])
    coded = bpe.encode(df, tokenizer_path()).select("row.doc_id", "ids")
    back = {r["row"]["doc_id"]: r["text"] for r in bpe.decode(coded, tokenizer_path()).collect()}
    assert back == {1: "hello , wörld ! 4 2 ", 2: "", 3: ""}


def test_round_trip_digests(spark, library):
    got = bpe.round_trip(table(spark, ODD), tokenizer_path()).collect()
    texts = Counter((i, t or "") for i, t in ODD)
    want = []
    for (i, t), n in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want += [(i or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] * n
    assert sorted((r[0] or 0, *r[1:4]) for r in got) == sorted(want)
    assert {r["text_sha256"] for r in got if r["doc_id"] == 5} == {sha("word " * 3000)}
    assert bpe.round_trip(table(spark, []), tokenizer_path()).count() == 0


def best_fill(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums |= {s + k * length for s in sums for k in range(1, n + 1) if s + k * length <= capacity}
    return max(sums)


def test_fill_is_the_closest_multiset():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        capacity = rng.randint(0, 120)
        chosen = packing.fill(counts, capacity)
        assert all(0 < n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == best_fill(counts, capacity)


def test_packing_covers_every_id_once(spark, library):
    rng = random.Random(5)
    pairs = ODD + [(1000 + i, "the cat sat " * rng.randint(1, 900)) for i in range(60)]
    rows = packing.pack(table(spark, pairs), tokenizer_path()).collect()
    ids = {}
    for i, t in pairs:
        ids.setdefault(i, []).append(array("I", [*library.encode(t or "", add_special_tokens=False).ids, packing.END]))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        assert Counter(n for r in found for n in range(r["start"], r["start"] + r["length"])) == Counter(n for own in ids[i] for n in range(len(own)))
        for r in found:
            assert r["doc_tokens"] == len(ids[i][0]) and r["ids_crc32"] == zlib.crc32(ids[i][0][r["start"] : r["start"] + r["length"]].tobytes())
    padding = total = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding <= 0.01 * total
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0


def test_language_of_held_out_texts(spark, data):
    """The query's own split: it learns from rows whose crc32 modulo 4 is not 2, and is right on the others."""
    base = data.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = queries.op6_language_id(spark, base).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_sample_is_bounded_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING", 12)
    rows = [(i // 2, f"text {i} of l{i % 3}", f"l{i % 3}") for i in range(300)] + [(7, "the same", "l9")] * 400 + [(None, "no id", "l9")] * 5
    a, b = (sorted(map(tuple, language_id.sampled(spark.createDataFrame(r, "doc_id bigint, text string, lang string"), "lang", "text", "doc_id").collect())) for r in (rows, rows[::-1]))
    assert a == b and len(a) == 3 * 3 + 2 and ("l9", "the same") in a and ("l9", "no id") in a


def test_language_of_odd_rows(spark):
    pairs = [*ODD, (11, "123 !?")]
    rows = [(i, t, "en") for i, t in pairs] + [(50 + i, "le chat et la souris dans la maison", "fr") for i in range(5)] + [(60, "untold", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["row"]["text"] or ""))) and 0 <= r["score"] <= 1
    empty = df.limit(0)
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(empty, nothing).count() == 0
    only = language_id.train(df.filter("lang = 'fr'"))
    assert {r["lang_pred"] for r in language_id.identify(df.filter("lang = 'fr'"), only).collect()} == {"fr"}


def test_all_of_many_languages_are_learned(spark):
    names = {f"l{k:02}": "".join(chr(0x400 + 13 * k + d) for d in range(12)) for k in range(70)}
    rows = [(n, " ".join([word] * (3 + n % 3)), lang) for n, (lang, word) in enumerate(x for x in names.items() for _ in range(4 if x[0] < "l64" else 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df)
    assert set(model.languages) == set(names)
    got = language_id.identify(df.filter("lang >= 'l64'"), model).collect()
    assert any(r["lang_pred"] == r["row"]["lang"] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 20])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(code.ravel()) <= {1.0, -1.0}


def test_folding():
    assert toxicity.fold("Y0u 1D10T, ѕtuріd… $cum") == " you idiot stupid scum "
    assert toxicity.fold("id!ot id|ot! you idiot!! wow!!great !diot | x") == " idiot idlot you idiot wow great idiot x "
    assert toxicity.fold("ｉｄｉｏｔ ɪᴅɪᴏᴛ 𝓲𝓭𝓲𝓸𝓽 ιdιоτ i\u200bdiot") == " idiot idiot idiot idiot idiot "
    assert toxicity.readings(toxicity.fold("ïdíöt Straße")) == (" ïdíöt straße ", " idiot strasse ") and toxicity.readings(" a ") == (" a ",)
    assert toxicity.fold(None) == toxicity.fold("") == "  "
    assert all(len(odd) == len(plain) for odd, plain in toxicity.LOOKALIKES.values())


def test_exceptions_cancel_matches():
    model = toxicity.Model({" tras": 5.0, " idiot ": 5.0}, ("trash can",), (-3.0, 2.0, 0.1))
    automaton = model.automaton()
    assert model.signs("the trash can", automaton)[0] == 0 and model.signs("the trash cans", automaton)[0] > 0
    assert model.score("such trash", automaton) > 0.5 > model.score("", automaton)
    assert model.score("you idiot!", automaton) == model.score("you idiot", automaton) == model.score("you ïdiot", automaton) > 0.5
    folded = toxicity.fold("Take the trash can, idiot")
    assert toxicity.phrases(folded, model.matched(folded, automaton)) == {"can idiot"}
    model.exceptions = ()
    assert toxicity.phrases(folded, model.matched(folded, model.automaton())) == {"the trash", "trash can", "can idiot"}


def test_exceptions_are_learned(spark):
    """trash marks toxic texts, but not in trash can; the same rows in another order teach the same."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprsv") + rng.choice("aeiou") for _ in range(4))
    text = lambda *own: " ".join(sorted([word() for _ in range(30)] + list(own), key=lambda _: rng.random()))
    rows = [(i, text("trash"), 1) for i in range(200)] + [(1000 + i, text(*(["trash can"] if i < 40 else [])), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    models = [toxicity.train(x, x.select("doc_id", "toxic")) for x in (df, spark.createDataFrame(rows[::-1], df.schema).repartition(5))]
    assert models[0] == models[1] and "trash can" in models[0].exceptions and any(e.startswith(" tras") for e in models[0].lexicon)
    automaton = models[0].automaton()
    assert models[0].score(text("trash"), automaton) >= 0.5 > models[0].score(text("trash can"), automaton)


def test_toxicity_of_held_out_texts(spark, data):
    """The query's own split: it learns from rows whose crc32 modulo 5 is not 0."""
    base = data.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, base).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    bad, good = ([r["predicted"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == y] for y in (1, 0))
    assert len(bad) > 20 and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def test_bytes_that_are_no_utf8(spark):
    """They are read as the replacement character where text is read, and as themselves where bytes are."""
    df = spark.sql("SELECT 1L AS doc_id, decode_bad AS text, 'en' AS lang FROM (SELECT cast(x'61FF6220C3' AS string) AS decode_bad) UNION ALL SELECT 2L, 'plain words', 'en'")
    assert {r["predicted"] for r in toxicity.score(df, toxicity.Model()).collect()} == {0}
    assert {r["lang_pred"] for r in language_id.identify(df, language_id.train(df)).collect()} == {"en"}
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(df, tokenizer_path()).collect()}
    pieces = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(df, tokenizer_path()).collect()}
    want = len(tokenizers.Tokenizer.from_file(tokenizer_path()).encode("a\ufffdb \ufffd", add_special_tokens=False).ids)
    assert tokens[1] == want and pieces[1] == want + 1
    assert {r["n_words"] for r in lm_scoring.lm_scores(df).collect()} == {2}
    assert exact_dedup.exact_dedup(df).count() == 2 and simhash.near_duplicates(df).count() == 2


def test_toxicity_of_odd_rows(spark):
    df = table(spark, ODD)
    none = toxicity.train(df, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    got = toxicity.score(df, none).collect()
    assert len(got) == len(ODD) and {r["predicted"] for r in got} == {0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id bigint, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(df, toxicity.train(df, labels)).collect())
    assert toxicity.score(table(spark, []), none).count() == 0
