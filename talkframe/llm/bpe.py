"""BPE encoding and decoding with a public tokenizer, exact for whole texts.

Ordinary text splits at white space: the tokenizer drops white space and no
merge, normalisation or pattern reaches across it, so each chunk is encoded
once per task and looked up afterwards (a bounded cache).  A chunk that no
white space splits for more than ``leaf`` bytes goes through *tree
concatenation*: its leaves are encoded in parallel as rows of their own, and
halves are joined pairwise.  At each join a window around the cut is encoded
again and grows until its first and last tokens agree exactly with the tokens
of both sides; then the window replaces what lay around the cut.  If no window
agrees it ends up as the whole of both halves, which is the plain encoding.

Why agreement proves the join: in BPE a sequence of tokens is the encoding of
its text exactly if every neighbouring pair is, and each pair of the joined
sequence lies within one of the three encodings.

The vocabulary file is a parameter and is read on the executors, once for
each worker process.

Cases: a null text is empty; an empty text has no tokens; strings of special
tokens in a text become those tokens, as in the library; repeated rows are
encoded alike; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.words import buffers

LEAF = 4096
AGREE = 4
_CACHE_ROWS = 120_000
#: Punctuation that may end a chunk and is a token run of its own after a letter.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_coders: dict[str, Coder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Piece:
    """Ids of a text and the span of code points that each one covers."""

    __slots__ = ("ids", "spans", "text")

    def __init__(self, text: str, ids: list[int], spans: list[tuple[int, int]]):
        self.text, self.ids, self.spans = text, ids, spans


class Coder:
    """The tokenizer of one worker process, with bounded caches.

    Of two generations of each cache, the older is dropped when the younger is
    full; what is still in use moves over.  An entry is (tokens, ids joined by
    a space, decoded text).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        whole = self.encode("ab c.d, e").ids
        if whole != [i for x in ("ab", "c", ".", "d", ",", "e") for i in self.encode(x).ids]:
            raise ValueError("this operator needs a tokenizer that drops white space and splits letters from punctuation")
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache, self.old = {}, {}
        self.words, self.old_words = {}, {}
        self.closing: dict[str, bool] = {}

    def encode(self, text: str) -> Piece:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return Piece(text, e.ids, e.offsets)

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def _entry(self, ids):
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _whole(self, texts: list[str]):
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield self._entry(e.ids)

    def _closes(self, letter: str) -> bool:
        """Whether punctuation after ``letter`` starts a token of its own (asked of the library).

        Some letters do not end as letters: a dotted capital I is lower-cased to an
        i and a combining dot, and the dot goes with the punctuation that follows.
        """
        if letter not in self.closing:
            self.closing[letter] = self.encode(f"{letter}.").ids == self.encode(letter).ids + self.encode(".").ids
        return self.closing[letter]

    def _learn_words(self, words) -> None:
        """Words of letters only: many in one call, told apart by their word-end tokens."""
        if len(self.words) > _CACHE_ROWS:
            self.old_words, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                known = self.old_words.get(w)
                if known:
                    self.words[w] = known
                else:
                    new.append(w)
        blocks = [new[i:i + 256] for i in range(0, len(new), 256)]
        found = self.tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, found):
            ids = e.ids
            end = np.flatnonzero(self.ends_word[ids]) + 1
            if len(end) != len(block):
                self.words.update(zip(block, self._whole(block)))
                continue
            a = 0
            for w, b in zip(block, end.tolist()):
                self.words[w] = self._entry(ids[a:b])
                a = b

    def learn(self, chunks) -> None:
        """Put all ``chunks`` into the cache."""
        if len(self.cache) > _CACHE_ROWS:
            self.old, self.cache = self.cache, {}
        split, whole = [], []
        for c in chunks:
            if c in self.cache:
                continue
            known = self.old.get(c)
            if known:
                self.cache[c] = known
                continue
            text = c.decode()
            head = text.rstrip(_TAIL)
            if head.isalpha() and (head[-1] < "\x80" or self._closes(head[-1])):
                split.append((c, head.lower() if head.isascii() else head, text[len(head):]))
            else:
                whole.append((c, text))
        self._learn_words({w for _, w, _ in split})
        tails = [t for t in {t for _, _, t in split} if t]
        tail = dict(zip(tails, self._whole(tails)))
        for c, w, t in split:
            e = self.words[w]
            if t:
                f = tail[t]
                e = (e[0] + f[0], f"{e[1]} {f[1]}", f"{e[2]} {f[2]}")
            self.cache[c] = e
        for (c, _), e in zip(whole, self._whole([t for _, t in whole])):
            self.cache[c] = e


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _window_start(p: Piece, i: int) -> int:
    """``i`` moved left to a token that begins a code point of its own."""
    while i > 0 and p.spans[i][0] < p.spans[i - 1][1]:
        i -= 1
    return i


def _window_end(p: Piece, j: int) -> int:
    """``j`` (one past the last token) moved right to the end of a code point."""
    while 0 < j < len(p.ids) and p.spans[j][0] < p.spans[j - 1][1]:
        j += 1
    return j


def concat(left: Piece, right: Piece, encode) -> Piece:
    """The encoding of ``left.text + right.text`` out of those of its halves."""
    at, w = len(left.text), 16
    while True:
        i = _window_start(left, max(0, len(left.ids) - w))
        j = _window_end(right, min(len(right.ids), w))
        lo = left.spans[i][0] if i else 0
        hi = right.spans[j - 1][1] if j < len(right.ids) else len(right.text)
        mid = encode(left.text[lo:] + right.text[:hi])
        spans = [(a + lo, b + lo) for a, b in mid.spans]
        head = list(zip(left.ids[i:i + AGREE], left.spans[i:i + AGREE]))
        tail = [(t, (a + at, b + at)) for t, (a, b) in zip(right.ids[max(0, j - AGREE):j], right.spans[max(0, j - AGREE):j])]
        got = list(zip(mid.ids, spans))
        if ((i == 0 or (len(head) == AGREE and got[:AGREE] == head))
                and (j == len(right.ids) or (len(tail) == AGREE and got[-AGREE:] == tail))):
            rest = [(a + at, b + at) for a, b in right.spans[j:]]
            return Piece(left.text + right.text, left.ids[:i] + mid.ids + right.ids[j:], left.spans[:i] + spans + rest)
        w *= 2


def tree(pieces: list[Piece], encode) -> Piece:
    """Join neighbours level by level until one piece is left."""
    while len(pieces) > 1:
        pairs = [concat(a, b, encode) for a, b in zip(pieces[::2], pieces[1::2])]
        pieces = pairs + pieces[len(pieces) - len(pieces) % 2:]
    return pieces[0]


_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                     ("ids", pa.list_(pa.int32()))])
_DIGEST_TYPE = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,ids:array<int>>"


def _digests(parts, with_ids: bool = False) -> dict:
    """Count, SHA-256 of the ids and of the decoded text, of chunk encodings in order."""
    parts = [p for p in parts if p[0]]
    ids = " ".join([p[1] for p in parts])
    text = " ".join([p[2] for p in parts])
    return {"n_tokens": sum(p[0] for p in parts), "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
            "ids": np.array(ids.split(), np.int32) if with_ids else None}


def _chunked(col: pa.Array, c: Coder):
    """Chunk lists of each text; the chunks of a block of texts are cached first."""
    data, offs = buffers(col)
    held, size = [], 0
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        held.append(data[a:b].tobytes().split())
        size += b - a
        if size > 1 << 20:
            c.learn(set().union(*held))
            yield from held
            held, size = [], 0
    c.learn(set().union(*held))
    yield from held


def _short_digests(path: str, with_ids: bool):
    def run(col: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([_digests([c.cache[x] for x in chunks], with_ids) for chunks in _chunked(col, c)], _DIGEST)
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _DIGEST_TYPE)


def _is_long(text: str, leaf: int) -> Column:
    """Whether a run without white space reaches ``leaf`` code points."""
    return F.coalesce((F.length(text) >= leaf) & F.col(text).rlike(f"[^\\x20\\x09-\\x0D]{{{leaf}}}"), F.lit(False))


def _leaves(leaf: int):
    """Parts of a text in order: runs of ordinary chunks (run -1) and leaves of long runs."""
    def cut(col: pa.Array) -> pa.Array:
        out = []
        for text in col.to_pylist():
            parts, plain, run = [], [], 0
            for chunk in (text or "").encode().split():
                s = chunk.decode()
                if len(s) < leaf:
                    plain.append(s)
                    continue
                if plain:
                    parts.append({"run": -1, "part": " ".join(plain)})
                    plain = []
                pieces = 1 << max(0, (len(s) - 1) // leaf).bit_length()  # halves of halves
                edges = [len(s) * i // pieces for i in range(pieces + 1)]
                parts += [{"run": run, "part": s[a:b]} for a, b in zip(edges, edges[1:]) if a < b]
                run += 1
            if plain:
                parts.append({"run": -1, "part": " ".join(plain)})
            out.append(parts)
        return pa.array(out, pa.list_(pa.struct([("run", pa.int32()), ("part", pa.string())])))
    cut.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, "array<struct<run:int,part:string>>")


def _leaf_ids(path: str):
    """Ids and span starts/ends of each part, encoded on its own."""
    def run(col: pa.Array) -> pa.Array:
        c = coder(path)
        found = [c.encode(t or "") for t in col.to_pylist()]
        return pa.array([{"ids": p.ids, "a": [s[0] for s in p.spans], "b": [s[1] for s in p.spans]} for p in found],
                        pa.struct([("ids", pa.list_(pa.int32())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<ids:array<int>,a:array<int>,b:array<int>>")


def _joined_ids(path: str):
    """Ids of whole texts out of their ordered parts."""
    def run(col: pa.Array) -> pa.Array:
        c, out = coder(path), []
        for parts in col:
            ids, held = [], []
            for p in [*sorted(parts.as_py(), key=lambda x: x["pos"]), {"run": -1, "ids": [], "a": [], "b": [], "part": ""}]:
                if held and held[0][0] != p["run"]:
                    ids += tree([x[1] for x in held], c.encode).ids
                    held = []
                if p["run"] < 0:
                    ids += p["ids"]
                else:
                    held.append((p["run"], Piece(p["part"], p["ids"], list(zip(p["a"], p["b"])))))
            out.append(ids)
        return pa.array(out, pa.list_(pa.int32()))
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")


def _long_ids(docs: DataFrame, text: str, path: str, leaf: int) -> DataFrame:
    """(text, ids) of the distinct texts that hold a long run; parts are encoded in parallel."""
    parts = (docs.select(F.col(text).alias("_t")).where(_is_long("_t", leaf)).distinct()
             .select("_t", F.sha2("_t", 256).alias("_h"))
             .select("_h", F.posexplode(_leaves(leaf)("_t")).alias("pos", "p")))
    encoded = (parts.select("_h", "pos", "p.run", "p.part").repartition(F.col("_h"), F.col("pos"))
               .withColumn("e", _leaf_ids(path)("part")))
    return (encoded.groupBy("_h").agg(F.collect_list(F.struct("pos", "run", "part", "e.ids", "e.a", "e.b")).alias("parts"))
            .select("_h", _joined_ids(path)("parts").alias("_ids")))


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.

    The digests are of the decimal ids joined by a space and of the decoded text.
    """
    path = path or vocabulary()
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner, t = docs.toDF(*names), names[docs.columns.index(text)]

    def of_ids(col: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([_digests([c._entry(x)], with_ids) for x in col.to_pylist()], _DIGEST)
    of_ids.__annotations__ = {"col": pa.Array, "return": pa.Array}
    plain = inner.where(~_is_long(t, leaf)).select(*names, _short_digests(path, with_ids)(t).alias("_d"))
    long = (inner.where(_is_long(t, leaf)).withColumn("_h", F.sha2(t, 256)).join(_long_ids(inner, t, path, leaf), "_h")
            .select(*names, F.arrow_udf(of_ids, _DIGEST_TYPE)("_ids").alias("_d")))
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    out = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    return plain.unionByName(long).select(*back, *[F.col(f"_d.{c}").alias(c) for c in out])


def decoded(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the text that the tokenizer makes of each array of ids."""
    path = path or vocabulary()

    def run(col: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([c.decode(x or []) for x in col.to_pylist()], pa.string())
    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, "string")(ids))
