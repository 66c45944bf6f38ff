"""BPE as a streaming transducer, and the decoder back.

How far a byte-pair merge can look ahead follows from the merge list. A token t
that ends at some place can only be changed by what comes after it if a rule
(t, z) takes it in, and whether z stands there depends on z's own right side at
an earlier rank. One pass over the rules in rank order adds these reaches up;
their maximum is the sufficient lookahead. Text is therefore encoded in a
window: tokens which end at least that far before the window's end are stable
and leave it, so memory is constant however long a word is. A boundary that no
merge ever crosses separates independent halves, so what stays in the window
is encoded as if it stood alone.

Words repeat, so each worker keeps a bounded memo of short words; it only saves
time. Texts are read in blocks, and block ends fall between words. A run without
white space that is longer than a block is streamed too: it is normalised in
chunks, cut where the next character neither joins the one before nor moves it,
a chunk's last piece stays open for the next chunk, and its letters go into the
transducer as they come.

Normalising and splitting follow the tokenizer file: canonical composition,
white space to one space, lower case by character, contractions, runs of
letters, single digits, runs of other signs. Special tokens in a text become
their ids. Characters outside long-settled Unicode blocks are normalised and
split by the library's own components, as their classes differ by Unicode
version.

Decoding is an incremental machine: ids go to token strings, byte letters to
bytes, and bytes to text through a UTF-8 decoder that holds an incomplete
character until its end comes. A tokenizer file without a decoder makes the
library's ``decode`` join the bare token strings by spaces, word ends and byte
letters as they are; the machine gives that string too, and the query holds the
one against the library and gives a digest of the other beside it.

Defined cases: null text is empty, and an empty text has no ids and decodes to
the empty text; bytes that are no UTF-8 are read as the replacement character;
texts of any length and runs of any length take constant memory beside the text
itself, but for a character under very many marks, which is one unit; repeated
rows are encoded each; other columns pass through untouched inside ``row`` or are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, spread, texts_of, widened

#: Memo entries for a worker; the memo starts anew when it is full.
MEMO = 300_000
#: The same for runs that the library encodes, which take less memory each.
LIBRARY_MEMO = 1_200_000
#: Longer words are not kept in the memo.
MEMO_LETTERS = 48
#: Characters of text handled at once.
BLOCK = 1 << 16
#: Characters of a run that are normalised at once where a run is streamed.
CHUNK = 1 << 12
#: White space as the tokenizer's pattern has it; Python's own class has four more.
SPACE = "[^\\S\x1c-\x1f]"
#: Letters, digits and signs whose classes are the same in all Unicode versions in use.
SETTLED = re.compile("[^\x00-ȶ̀-ʹΆ-ώЀ-ҁҊ-ԓ‐-‧‰-⁞₠-₱←-⇿ぁ-ゖァ-ヺ一-龥가-힣]")

#: Signs that close a word.
CLOSING = ".,;:!?"
#: Letters that are not their own composed form, or whose lower case depends on more than the letter.
ODD_LETTERS = re.compile("[^A-Za-zÀ-ÖØ-öø-ıĲ-ȯĐđ]|[İŉ]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that compose with the one before them: second halves of canonical pairs, and vowels and finals of Hangul."""
    found = {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
    for c in map(chr, range(0xC0, 0x110000)):
        pair = unicodedata.decomposition(c).split()
        if len(pair) == 2 and not pair[0].startswith("<"):
            found.add(chr(int(pair[1], 16)))
    return frozenset(found)


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "</w>") -> int:
    """Symbols beyond a token's end that can decide whether it stays; see the module's text."""
    width = lambda t: max(1, len(t.removesuffix(suffix)))
    taken: dict[str, int] = {}  # how far beyond t the rules so far look to take it in
    formed: dict[str, int] = {}  # how far beyond t's end one looks to know that it forms
    for a, b in merges:
        reach = max(taken.get(b, 0), formed.get(b, 0), formed.get(a, 0) - width(b))
        formed[a + b] = reach
        taken[a] = max(taken.get(a, 0), width(b) + max(taken.get(b, 0), formed.get(b, 0)))
    return max([0, *taken.values(), *formed.values()])


class Transducer:
    """Letters of one word in, ids out as soon as they are stable."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, suffix)
        self.window = 4 * (self.lookahead + 1)

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges, lowest rank first and leftmost first."""
        return self._few(symbols) if len(symbols) < 40 else self._many(symbols)

    def _few(self, s: list[str]) -> list[str]:
        rank, far = self.rank.get, 1 << 60
        ranks = [rank(p, far) for p in zip(s, s[1:], strict=False)]
        while ranks and (low := min(ranks)) < far:
            i = ranks.index(low)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((s[i - 1], s[i]), far)
            if i < len(ranks):
                ranks[i] = rank((s[i], s[i + 1]), far)
        return s

    def _many(self, s: list[str]) -> list[str]:
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self.rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(s)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j], after[i] = a + b, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((live[x], live[y]))) is not None:
                    heapq.heappush(heap, (r, x, live[x], live[y]))
        return [x for x in live if x is not None]

    def word(self, letters: Iterator[str]) -> Iterator[int]:
        """Ids of one word, whose byte letters may come in any number; holds one window of them."""
        held: list[str] = []
        last = None
        window = self.window
        for letter in letters:
            if last is not None:
                held.append(last)
                if len(held) >= window:
                    held = yield from self._stable(held)
            last = letter
        if last is not None:
            held.append(last + self.suffix)
            yield from map(self.vocab.__getitem__, self.merged(held))

    def _stable(self, held: list[str]):
        """Emits what can no longer change; returns the rest of the window."""
        at, limit = 0, len(held) - self.lookahead
        for symbol in self.merged(list(held)):
            if at + len(symbol) > limit:
                break
            at += len(symbol)
            yield self.vocab[symbol]
        return held[at:]


class Codec:
    """A tokenizer file of the word-end kind, read for streaming."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.path, self.suffix = path, model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.transducer = Transducer(model["vocab"], merges, self.suffix)
        self.tokens = [""] * (1 + max(*model["vocab"].values(), *self.special.values()))
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = token
        self.letter = byte_letters()
        self.byte = {c: b for b, c in self.letter.items()}
        self.numerals = [str(i) for i in range(len(self.tokens))]
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(parts[0]["pattern"]["Regex"])
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.contractions = set(re.findall(r"'[a-z]+", parts[0]["pattern"]["Regex"]))
        self.memo: dict[str, array] = {}
        self.words: dict[str, array] = {}
        self._library = None
        self._bytes: list[bytes] | None = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def split(self, run: str) -> Iterator[str]:
        """The words of text that holds no special token."""
        if SETTLED.search(run):
            norm, pre = self.library.normalizer.normalize_str(run), self.library.pre_tokenizer
            for letters, _ in pre.pre_tokenize_str(norm):
                yield letters
            return
        run = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        letter = self.letter
        for m in self.pieces.finditer(run):
            word = m[0]
            yield word if word.isascii() and "\x20" < min(word) and "\x7f" not in word else "".join([letter[b] for b in word.encode()])

    def letters(self, piece: str) -> str:
        return "".join([self.letter[b] for b in piece.encode()])

    def _pieces(self, chunk: str) -> list[str]:
        """A chunk of a run, normalised and split."""
        if SETTLED.search(chunk):
            norm = self.library.normalizer.normalize_str(chunk)
            return [bytes(map(self.byte.__getitem__, x)).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return self.pieces.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def _parts(self, text: str, at: int, stop: int) -> Iterator[tuple[str, bool]]:
        """Byte letters of text[at:stop], a run without special tokens, and whether a word ends with them."""
        held, joins = "", joining()
        while at < stop:
            end = min(at + CHUNK, stop)
            while end < stop and not text[end].isascii() and (unicodedata.combining(text[end]) or text[end] in joins):
                end += 1
            pieces = self._pieces(held + text[at:end])
            at, held = end, ""
            if at < stop and pieces and pieces[-1] not in self.contractions:
                # The last piece may go on. What decides how is held back: its last sign, and an apostrophe before it.
                last = pieces.pop()
                if pieces and pieces[-1] == "'" and any(x.startswith("'" + last) for x in self.contractions):
                    held = pieces.pop() + last
                else:
                    n = 2 if last.endswith("'") else 1
                    held = last[-n:]
                    if len(last) > n:
                        pieces.append(last[:-n])
                        yield from ((self.letters(x), True) for x in pieces[:-1])
                        yield self.letters(pieces[-1]), False
                        continue
            yield from ((self.letters(x), True) for x in pieces)
        if held:
            yield from ((self.letters(x), True) for x in self._pieces(held))

    def stream(self, text: str, at: int, stop: int) -> Iterator[array]:
        """Ids of a run text[at:stop] of any length, in arrays of bounded size."""

        def words(parts: Iterator[tuple[str, bool]]) -> Iterator[int]:
            for part, ends in parts:

                def letters(part=part, ends=ends):
                    yield from part
                    while not ends:
                        part, ends = next(parts)
                        yield from part

                yield from self.transducer.word(letters())

        for m in chain(self.specials.finditer(text, at, stop), (None,)):
            ids = words(self._parts(text, at, m.start() if m else stop))
            while block := array("I", islice(ids, CHUNK)):
                yield block
            if m:
                yield array("I", [self.special[m[0]]])
                at = m.end()

    def word(self, word: str) -> array:
        """Ids of one word of byte letters."""
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", self.transducer.word(iter(word)))
            if len(word) <= MEMO_LETTERS:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def run(self, run: str) -> array:
        """Ids of a run without white space."""
        ids = array("I")
        at = 0
        for m in self.specials.finditer(run) if "<|" in run else ():
            for word in self.split(run[at : m.start()]):
                ids += self.word(word)
            ids.append(self.special[m[0]])
            at = m.end()
        for word in self.split(run[at:]):
            ids += self.word(word)
        return ids

    def blocks(self, text: str) -> Iterator[list[str] | tuple[int, int]]:
        """The runs between white space, a block at a time; of a run that passes a block's end by far, its place. No normalising step crosses white space."""
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        space = re.compile(SPACE)
        cut = lambda block: [x for x in re.split(f"{SPACE}+", block) if x] if odd else block.split()
        at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                m = space.search(text, end)
                stop = m.start() if m else len(text)
                if stop - end > BLOCK:
                    begin = max((x.end() for x in space.finditer(text, at, end)), default=at)
                    if begin > at:
                        yield cut(text[at:begin])
                    yield begin, stop
                    at = stop
                    continue
                end = stop
            yield cut(text[at:end])
            at = end

    def encode_stream(self, text: str | None) -> Iterator[array]:
        """Ids of a text, in arrays of unsigned 32-bit numbers, a block at a time."""
        text = text or ""
        for runs in self.blocks(text):
            if isinstance(runs, tuple):
                yield from self.stream(text, *runs)
                continue
            memo = self.memo
            ids = array("I")
            for x in runs:
                got = memo.get(x)
                if got is None:
                    got = self.run(x)
                    if len(x) <= MEMO_LETTERS:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[x] = got
                ids += got
            yield ids

    @property
    def bytes(self) -> list[bytes]:
        """What each token writes: byte letters as bytes, a word's end as a space, specials as they are."""
        if self._bytes is None:
            specials = set(self.special.values())

            def written(i: int, token: str) -> bytes:
                if i in specials:
                    return token.encode()
                end = token.endswith(self.suffix)
                plain = token[: len(token) - len(self.suffix)] if end else token
                return bytes(map(self.byte.__getitem__, plain)) + (b" " if end else b"")

            self._bytes = [written(i, t) for i, t in enumerate(self.tokens)]
        return self._bytes


class Decoder:
    """Ids in, text out, a block at a time. Holds an incomplete character and whether anything came yet, nothing else."""

    def __init__(self, own: Codec):
        self.own, self.begun = own, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: array) -> tuple[str, str]:
        """(readable text so far complete, what the library's decode returns for these ids after the ones before)."""
        if not ids:
            return "", ""
        joined = (" " if self.begun else "") + " ".join(map(self.own.tokens.__getitem__, ids))
        self.begun = True
        return self.utf8.decode(b"".join(map(self.own.bytes.__getitem__, ids))), joined

    def end(self) -> str:
        """What was held of a character that never ended."""
        return self.utf8.decode(b"", True)


class LibraryIds:
    """Ids by the library itself, which sees each run between white space once while the memo holds it.

    Runs that are new go to the library in one string, with a lone NUL between
    them: white space keeps it a word of its own, whose id marks their ends. A
    run that holds a NUL or a special's first signs goes alone.
    """

    def __init__(self, path: str):
        self.own = codec(path)
        self.mark_id = self.own.library.encode("\x00", add_special_tokens=False).ids[0]
        self.memo: dict[str, bytes] = {}

    def _library(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        tokenizer = self.own.library
        alone = [x for x in runs if "<|" in x or "\x00" in x]
        plain = [x for x in runs if not ("<|" in x or "\x00" in x)] if alone else runs
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            ids = tokenizer.encode_batch_fast([" \x00 ".join(part)], add_special_tokens=False)[0].ids  # without places in the text
            data, begin = array("I", ids).tobytes(), 0
            for x in part[:-1]:
                end = ids.index(self.mark_id, begin)
                yield x, data[4 * begin : 4 * end]
                begin = end + 1
            yield part[-1], data[4 * begin :]
        for x in alone:
            yield x, array("I", tokenizer.encode(x, add_special_tokens=False).ids).tobytes()

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """Puts the ids of runs into the memo; those of long runs come back, for this once.

        A run of letters and closing signs takes its word's ids and the signs':
        letters and signs are split before merging, and letters count in lower
        case, so "Word," needs no more than "word" and ",".
        """
        memo, once, parts = self.memo, {}, {}
        for x in runs:
            word = x.rstrip(CLOSING)
            low = word.lower()
            if (word != x or low != word) and word.isalpha() and (word.isascii() or not ODD_LETTERS.search(word)):
                parts[x] = (low, x[len(word) :])
        direct = runs.difference(parts)
        direct.update(low for low, _ in parts.values())
        direct.update(sign for _, sign in parts.values() if sign)
        for x, ids in self._library(list(direct.difference(memo))):
            (memo if len(x) <= MEMO_LETTERS else once)[x] = ids
        for x, (low, sign) in parts.items():
            ids = (memo.get(low) or once[low]) + (memo[sign] if sign else b"")
            (memo if len(x) <= MEMO_LETTERS else once)[x] = ids
        return once

    def encode(self, texts: list[str | None]) -> list[array]:
        long = {k for k, t in enumerate(texts) if t and len(t) > BLOCK and any(isinstance(x, tuple) for x in self.own.blocks(t))}
        if long:  # runs that the library would hold whole
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in long]))
            return [array("I", chain.from_iterable(self.own.encode_stream(t))) if k in long else next(rest) for k, t in enumerate(texts)]
        runs = [blocks[0] if len(blocks) == 1 else [*chain.from_iterable(blocks)] for blocks in ([*self.own.blocks(t or "")] for t in texts)]
        every = set(chain.from_iterable(runs))
        new = every.difference(self.memo)
        if len(self.memo) + 2 * len(new) > LIBRARY_MEMO:
            self.memo.clear()
            new = every
        once = self._learn(new) if new else {}
        self.memo.update(once)  # long runs are in the memo for this batch only
        out = []
        for r in runs:
            ids = array("I")
            ids.frombytes(b"".join(map(self.memo.__getitem__, r)))
            out.append(ids)
        for x in once:
            del self.memo[x]
        return out


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        found = []
        for text in texts_of(batch.column(1)):
            n, machine, shas = 0, Decoder(own), [hashlib.sha256() for _ in range(3)]
            for ids in own.encode_stream(text):
                if ids:
                    shas[0].update(((" " if n else "") + " ".join(map(own.numerals.__getitem__, ids))).encode())
                    n += len(ids)
                    readable, joined = machine.push(ids)
                    shas[1].update(joined.encode())
                    shas[2].update(readable.encode())
            shas[2].update(machine.end().encode())
            found.append((n, *(x.hexdigest() for x in shas)))
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"],
        )


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and digests of the ids, of the library's string decoded from them, and of the readable text."""
    prepare(df.sparkSession)
    slim = spread(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lambda b: _digest(path, b), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string")


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with its rows' ids as an array column; df's own columns come back in the struct ``row``."""
    prepare(df.sparkSession)
    rows = spread(df).select(F.struct("*").alias("row"))
    schema = widened(rows, f"`{ids_col}` array<int>")

    def told(batches):
        own = codec(path)
        for batch in batches:
            texts = texts_of(batch.column(0).field(text_col))
            ids = [[i for part in own.encode_stream(t) for i in part] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["row", ids_col])

    return rows.mapInArrow(told, schema)


def _readable(own: Codec, ids: list[int]) -> str:
    machine = Decoder(own)
    parts = [machine.push(array("I", ids[at : at + BLOCK]))[0] for at in range(0, len(ids), BLOCK)]
    return "".join([*parts, machine.end()])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df's ids back to readable text, in a column beside the struct ``row``."""
    prepare(df.sparkSession)
    rows = df.select(F.struct("*").alias("row"))
    schema = widened(rows, f"`{out_col}` string")

    def told(batches):
        own = codec(path)
        for batch in batches:
            ids = batch.column(0).field(ids_col).to_pylist()
            texts = [_readable(own, x or []) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", out_col])

    return rows.mapInArrow(told, schema)
