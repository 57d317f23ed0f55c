"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent pre-tokens are compiled, with the ids of their merges, into a minimal acyclic (subsequential)
transducer that shares prefixes and suffixes; its flat form is a file that Spark brings to each executor once, and
all Python workers there map the same one. The new words of a batch are walked through it together.
Words that it doesn't hold are merged exactly, lowest rank first. The results are those of the
tokenizers library for a vocabulary of kind BPE with byte-level symbols and an end-of-word suffix.

Defined cases: null text is the empty text (no ids, empty decoded text); a repeated row gives a row
each time; an empty table gives an empty result; other columns are ignored; strings of special tokens
in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, once, settle, share, shared_map, ship

#: Words that the lexicon holds at most; its size is bounded by this, whatever the corpus is.
LEXICON_SIZE = 65_536
#: Bytes of them at most: the driver builds a state for a byte (half a kilobyte of memory each until equal ones are shared).
LEXICON_BYTES = 1 << 20
#: Pieces of text whose ids a worker remembers.
MEMO_SIZE = 400_000

# The pre-tokenizer pattern of the vocabulary file is read from the file itself.


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """What the tokenizer's file says, in the form that merging needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal = spec["model"], spec["normalizer"] or {}
        kinds = [n["type"] for n in normal.get("normalizers", [normal])]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE":
            raise ValueError(f"{path}: this kind of vocabulary is not known here: {kinds}")
        self.spec = json.dumps(spec)
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(s, -1) for s in symbols]
        self.last = [vocab.get(s + self.suffix, -1) for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.packed = {a << 20 | b: rank << 20 | new for (a, b), (rank, new) in self.merges.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")

    def ranked(self):
        """The same merges by tiktoken, or None if a token comes from several pairs.

        A last byte is marked by 0xFF, which UTF-8 never has, and the pair of both is the first to merge.
        """
        import tiktoken

        n, strings, merged = len(self.merges), {}, set()
        for b in range(256):
            strings[self.inner[b]], strings[self.last[b]] = bytes([b]), bytes([b, 255])
        ranks, back = {bytes([b]): b for b in range(256)}, [*self.inner]
        if self.suffix:
            ranks |= {bytes([b, 255]): 256 + b for b in range(256)}
            back += self.last
        for (a, b), (_, new) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            if a not in strings or b not in strings or new in merged or (raw := strings[a] + strings[b]) in ranks:
                return None
            merged.add(new)
            strings[new] = raw
            ranks[raw] = len(back)
            back.append(new)
        if min(back) < 0 or len(merged) != n:
            return None
        core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        at, end = back.__getitem__, b"\xff" if self.suffix else b""
        return lambda word: list(map(at, core(word + end)))

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        ids = [i for i in ids if i >= 0]
        return self._merge_long(ids) if len(ids) > 48 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Ranks of all neighbours stand in a list; a merge renews the two beside it."""
        get, none = self.packed.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            new = best & 0xFFFFF
            ids[at : at + 2] = [new]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """With a queue and links: time n log n for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := get((ids[i], ids[j]))) is not None:
                heapq.heappush(queue, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in ids if x >= 0]


#: Mark of a state where no word ends.
NO_WORD = -1
#: Bits of an output's length in a word of 64, of which the rest is its place in the pool.
_LENGTH = 24
_ONES = (1 << _LENGTH) - 1


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte -> [state, output]
        self.final = False
        self.tail: tuple = ()

    def key(self) -> tuple:
        return self.final, self.tail, tuple((b, id(s), out) for b, (s, out) in self.arcs.items())


def build_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal transducer of words and ids, flat.

    Words come in byte order; of two neighbours the common prefix stays open, the rest is frozen: each
    state is replaced by an equal one of the register, if any. Outputs move as near to the start as
    they can, so that the ends of words with different ids are shared too.
    """
    register: dict[tuple, _State] = {}

    def freeze(s: _State) -> _State:
        return register.setdefault(s.key(), s)

    path, previous = [_State()], b""
    for word in sorted(entries):
        if not word:
            continue
        out = tuple(entries[word])
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        for i in range(len(previous), same, -1):
            path[i - 1].arcs[previous[i - 1]][0] = freeze(path[i])
        del path[same + 1 :]
        for i in range(same, len(word)):
            path.append(_State())
            path[i].arcs[word[i]] = [path[i + 1], ()]
        path[-1].final = True
        for i in range(same):
            arc = path[i].arcs[word[i]]
            k = 0
            while k < min(len(arc[1]), len(out)) and arc[1][k] == out[k]:
                k += 1
            rest, arc[1] = arc[1][k:], arc[1][:k]
            if rest:
                below = path[i + 1]
                for x in below.arcs.values():
                    x[1] = rest + x[1]
                if below.final:
                    below.tail = rest + below.tail
            out = out[k:]
        if same == len(word):
            path[-1].tail = out
        else:
            path[same].arcs[word[same]][1] = out
        previous = word
    for i in range(len(previous), 0, -1):
        path[i - 1].arcs[previous[i - 1]][0] = freeze(path[i])

    number, order, todo = {id(path[0]): 0}, [path[0]], [path[0]]
    while todo:
        for s, _ in todo.pop().arcs.values():
            if id(s) not in number:
                number[id(s)] = len(order)
                order.append(s)
                todo.append(s)
    keys, targets, outs, pool, pooled = [], [], [], [], {(): (0, 0)}

    def place(out: tuple) -> int:
        if out not in pooled:
            pooled[out] = (len(pool), len(out))
            pool.extend(out)
        at, n = pooled[out]
        return at << _LENGTH | n

    finals = []
    for i, s in enumerate(order):
        finals.append(place(s.tail) if s.final else NO_WORD)
        for b, (t, out) in s.arcs.items():  # words came in byte order, so keys ascend
            keys.append(i << 8 | b)
            targets.append(number[id(t)])
            outs.append(place(out))
    if len(order) >= 1 << 24 or max(map(len, pooled)) >= 1 << _LENGTH:
        raise ValueError("a lexicon of too many states, or a word of too many ids")
    head = struct.pack("<4I", len(order), len(keys), len(pool), 0)
    return head + b"".join(np.array(x, kind).tobytes() for x, kind in zip((finals, outs, keys, targets, pool), _KINDS, strict=True))


#: Of the flat form's arrays: what ends in a state, outputs of arcs, their states and bytes, where they lead, ids.
_KINDS = ("<i8", "<i8", "<u4", "<u4", "<u4")


class Lexicon:
    """A lexicon's flat form, memory-mapped; words are walked through it together, byte by byte."""

    def __init__(self, view):
        states, arcs, pool, _ = struct.unpack_from("<4I", view)
        at, parts = 16, []
        for n, kind in zip((states, arcs, arcs, arcs, pool), _KINDS, strict=True):
            parts.append(np.frombuffer(view, kind, n, at))
            at += parts[-1].nbytes
        self.finals, self.outs, self.keys, self.targets, self.pool = parts

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit integers, or None for a word that isn't there."""
        if not words or not len(self.keys):
            return [None] * len(words)
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        text, begin = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(size) - size
        state, on, met = np.zeros(n, np.int64), np.flatnonzero(size), []
        there = size > 0
        for i in range(int(size.max())):
            key = (state[on] << 8 | text[begin[on] + i]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            there[on[~hit]] = False
            on, at = on[hit], at[hit]
            state[on] = self.targets[at]
            out = self.outs[at]
            some = out & _ONES > 0
            met.append((on[some], np.full(int(some.sum()), i), out[some]))
            on = on[size[on] > i + 1]
        last = self.finals[state]
        there &= last != NO_WORD
        some = np.flatnonzero(there & (last & _ONES > 0))
        met.append((some, size[some], last[some]))
        word, step, out = map(np.concatenate, zip(*met, strict=True))
        own = there[word]
        word, step, out = word[own], step[own], out[own]
        order = np.lexsort((step, word))
        word, at, length = word[order], out[order] >> _LENGTH, out[order] & _ONES
        ends = np.cumsum(length)
        ids = self.pool[np.repeat(at - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(np.bincount(word, length, n).astype(np.int64))]) * 4
        return [ids[a:z] if t else None for a, z, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), there.tolist(), strict=True)]

    def get(self, word: bytes) -> list[int] | None:
        found = self.find([word])[0]
        return None if found is None else array("I", found).tolist()


class Encoder:
    """Whole texts to ids and back. One for each worker process, with its lexicon's map and its memo."""

    def __init__(self, vocabulary: Vocabulary, lexicon=None):
        """lexicon: the flat form as bytes or a memory map."""
        import regex

        self.v = vocabulary
        self.lexicon = Lexicon(lexicon) if lexicon is not None else None
        self.merge = vocabulary.ranked() or vocabulary.merge
        self.names = [b""] * (1 + max(vocabulary.tokens))
        for i, t in vocabulary.tokens.items():
            self.names[i] = t.encode()
        self.find = regex.compile(vocabulary.pattern).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.nameless = regex.compile(r"\p{Cn}").match
        self.fine: set[str] = set()
        self.library = None
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str):
        """Parts of a normalised text that no pre-token crosses: what blanks part."""
        return [text] if self.odd(text) else text.split()

    def words_in(self, piece: str) -> list[str]:
        """The pattern's matches; letters alone, or with one mark behind them, need no search."""
        if piece.isalpha():
            return [piece]
        if piece[-1:] in ",.;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.find(piece)

    def learn(self, pieces: set[str]) -> None:
        """Ids and decoded texts of pieces, from now on remembered: words that the lexicon has from it, all at once, others merged."""
        parts = [(p, self.words_in(p)) for p in pieces]
        words = list({w for _, ws in parts for w in ws})
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        of = {}
        for word, own, ids in zip(words, raw, found, strict=True):
            got = array("I", self.merge(own)) if ids is None else array("I", ids)
            of[word] = got.tobytes(), b" ".join([self.names[x] for x in got])
        for piece, ws in parts:
            if len(ws) == 1:
                self.memo[piece] = of[ws[0]]
            else:
                self.memo[piece] = b"".join([of[w][0] for w in ws]), b" ".join([of[w][1] for w in ws if of[w][1]])

    def agreed(self, text: str) -> bool:
        """Whether all characters have a meaning in the tables of Python and of `regex`: without one, libraries may differ in them."""
        for c in set(text) - self.fine:
            if unicodedata.category(c) == "Cn" or self.nameless(c):
                return False
            self.fine.add(c)
        return True

    def by_library(self, text: str) -> tuple[bytes, bytes]:
        """The same from the library itself, for texts with characters that tables of Unicode don't agree on."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.v.spec)
            self.library.no_truncation()
            self.library.no_padding()
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes(), self.library.decode(ids, skip_special_tokens=False).encode()

    def __call__(self, text: str | None) -> tuple[bytes, bytes]:
        return self.encode([text])[0]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        if len(self.memo) > MEMO_SIZE:
            self.memo.clear()
        plans: list = []  # for each text: what the library says, or parts: a special token's string, or pieces
        new: set[str] = set()
        for text in texts:
            if not text:
                plans.append([])
            elif not text.isascii() and not self.agreed(text):
                plans.append(self.by_library(text))
            else:
                parts = self.split_special(text) if self.split_special and "<|" in text else [text]
                plans.append([part if i % 2 else self.pieces(self.normal(part)) for i, part in enumerate(parts)])
                for part in plans[-1][::2]:
                    new.update(part)
        self.learn(new.difference(self.memo))
        out, memo = [], self.memo
        for plan in plans:
            if isinstance(plan, tuple):
                out.append(plan)
                continue
            ids, decoded = [], []
            for part in plan:
                if isinstance(part, str):
                    ids.append(struct.pack("<I", self.v.special[part]))
                    decoded.append(part.encode())
                else:
                    found = [memo[p] for p in part]
                    ids += [f[0] for f in found]
                    decoded += [f[1] for f in found if f[1]]
            out.append((b"".join(ids), b" ".join(decoded)))
        return out


def count_words(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """(word, n): how often each pre-token occurs in all texts; counted by task before the shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        encoder = once("bpe words", shared.value, Encoder)

        def flush(c: Counter):
            words: Counter = Counter()
            for piece, n in c.items():
                for w in encoder.words_in(piece):
                    words[w] += n
            return pa.record_batch([pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    held.update(encoder.pieces(encoder.normal(x)))
            if len(held) > 400_000:
                yield flush(held)
                held.clear()
        if held:
            yield flush(held)

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = LEXICON_SIZE) -> bytes:
    """The lexicon of the most frequent words, `size` and LEXICON_BYTES at most, that occur twice at least."""
    top = most_frequent(settle(count_words(docs, vocabulary, text).where("n > 1 and length(word) < 256")), size, 2)
    room = np.cumsum([len(r.word) for r in top]) <= LEXICON_BYTES
    return build_lexicon({bytes(r.word): tuple(vocabulary.merge(bytes(r.word))) for r, fits in zip(top, room, strict=True) if fits})


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = LEXICON_SIZE) -> DataFrame:
    """(key, ids binary, decoded string) for each row. `path`: the tokenizer's file, read by the driver."""
    return _mapped(docs, path, key, text, size, "ids binary, decoded string", lambda ids, decoded: (ids, decoded.decode()))


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = LEXICON_SIZE) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what encode() gives, made where the ids are."""
    return _mapped(docs, path, key, text, size, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))


def _mapped(docs: DataFrame, path: str, key: str, text: str, size: int, out: str, of) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    vocabulary = Vocabulary(path)
    shared = spark.sparkContext.broadcast(vocabulary)
    lexicon = share(spark, fit_lexicon(docs, vocabulary, text, size))  # bounded by `size`
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in out.split(", "))]

    def run(batches):
        encoder = once("bpe", (shared.value, lexicon), lambda x: Encoder(x[0], shared_map(x[1])))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [of(*x) for x in encoder.encode(part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields))], names=[key, *(n for n, _ in fields)])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, f"{key} long, {out}")
