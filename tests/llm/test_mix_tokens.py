"""Source mixing, BPE and token counts against plain versions."""

import random

import pyarrow as pa
import pytest

import brute
from talkframe.llm import bpe, mixing, token_counts


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, size int")


def _mix_rows(seed):
    r = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "only-empty", "c"]
    rows = [(i, (s := r.choice(names)), " ".join("w" * r.randint(1, 3) for _ in range(0 if s == "only-empty" else r.randint(0, 40))), 1)
            for i in range(200)]
    return [*rows, (None, "a", "x y z", 0), (300, "a", None, 0), (3, rows[3][1], rows[3][2], 1), (301, "tiny", "one", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_brute_force(spark, seed):
    rows = _mix_rows(seed)
    sizes = mixing.sized(_docs(spark, rows)).cache()
    got = mixing.taken(sizes).collect()
    want = brute.mix([r[:3] for r in rows])
    assert sorted((-1 if r.id is None else r.id, r.source or "", r.size, r.taken) for r in got) == \
        sorted((rows[i][0] if rows[i][0] is not None else -1, rows[i][1] or "", len(brute.words(rows[i][2])), n) for i, n in want.items())
    goal = brute.targets({s: sum(len(brute.words(t)) for _, x, t, _ in rows if x == s) for s in {x[1] for x in rows}})
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.taken <= 3 * r.size
    for s, t in goal.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 0.5


def test_mixed_rows_follow_what_is_taken(spark):
    docs = _docs(spark, _mix_rows(3))
    out = mixing.mixed(docs)
    taken = {}
    for r in mixing.taken(mixing.sized(docs)).collect():
        taken[(r.id, r.source)] = -(-r.taken // r.size) if r.size else 0
    copies = {}
    for r in out.collect():
        copies[(r.doc_id, r.source)] = copies.get((r.doc_id, r.source), 0) + 1
    twice = (3, _mix_rows(3)[3][1])  # a repeated row
    assert copies.pop(twice, 0) == 2 * taken.pop(twice)
    assert copies == {k: n for k, n in taken.items() if n} and out.columns == docs.columns


def test_mix_of_an_empty_table(spark):
    empty = _docs(spark, [])
    assert mixing.taken(mixing.sized(empty)).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.taken(mixing.sized(_docs(spark, [(1, "a", None, 0)]))).collect()[0].taken == 0


ALPHABETS = ["abcdefgh", "the'sll''!!##", "aé漢字がABCΣσ", "'s", "éx́̂yz", "12345abc!", "🙂👍a", "ﬁŒß"]


@pytest.mark.parametrize("leaf", [16, 64])
def test_tree_concatenation_equals_the_library(leaf):
    c, r = bpe.coder(bpe.vocabulary()), random.Random(leaf)
    for k in range(120):
        a, n = r.choice(ALPHABETS), r.choice([60, 200, 1000])
        s = "".join(r.choice(a) for _ in range(n)) if k % 4 else (a * n)[:n]
        edges = list(range(0, len(s), leaf)) + [len(s)]
        got = bpe.tree([c.encode(s[x:y]) for x, y in zip(edges, edges[1:])], c.encode)
        want = c.encode(s)
        assert got.ids == want.ids and got.spans == want.spans


TEXTS = [None, "", " \n\t", "The, the THE. it's don't!! a<|endoftext|>b <|startoftext|>", "É è ﬁ ß Σς", "x́ a b\x1cc d",
         "BELEDİYESİ. İ! aİ, İ", "שּׁ. יִ! 각, ŉ. ǰ?", "word " * 3000, "aé" * 300 + " tail", "ab'" * 200, "plain\n\ntext  with   space", "1234567890 3.14"]


def test_query_rows_equal_the_library(spark):
    rows = [(i, "s", t, i) for i, t in enumerate(TEXTS)] + [(3, "s", TEXTS[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, ids string, text string, n int")
    out = bpe.encoded(docs.withColumnRenamed("ids", "c0"), leaf=64).collect()
    c = bpe.coder(bpe.vocabulary())
    assert len(out) == len(rows)
    for r in out:
        ids = c.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.c0 == "s"
        assert r.ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == brute.sha(c.decode(ids))
    back = bpe.decoded(bpe.encoded(docs.select("doc_id", "text"), leaf=64)).collect()
    assert all(r.decoded == c.decode(list(r.ids)) for r in back)
    assert bpe.encoded(docs.where("false").select("doc_id", "text")).count() == 0


def test_words_of_odd_letters_equal_the_library():
    """Letters whose case or normal form has another length, before and after punctuation."""
    import unicodedata
    c, r = bpe.Coder(bpe.vocabulary()), random.Random(8)
    every = [chr(x) for x in range(0xA0, 0x20000) if chr(x).isalpha()]
    odd = [x for x in every if len(x.lower()) > 1 or not unicodedata.normalize("NFC", x).lower().isalpha()]
    assert "İ" in odd and len(odd) > 10
    texts = [x + m for x in odd for m in (".", "a!", "")]
    texts += [" ".join("".join(r.choice(r.choice([odd, every, "aBc", ".,!", "İı"])) for _ in range(r.randint(1, 9))) for _ in range(9)) for _ in range(3000)]
    chunks = list(bpe._chunked(pa.array(texts), c))
    for text, own in zip(texts, chunks):
        assert [int(i) for x in own for i in c.cache[x][1].split()] == c.encode(text).ids, text


def test_query_on_documents_equals_the_library(spark):
    from talkframe.llm.queries import queries
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op5_bpe_round_trip"](spark, sf).collect()}
    c = bpe.coder(bpe.vocabulary())
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = c.tokenizer.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(c.decode(ids)))


def _attributed(text, rule):
    """Token by token, byte by byte."""
    encoding, _ = token_counts.coder(token_counts.vocabulary())
    raw, at, line_of, line = text.encode(), 0, [], 0
    for byte in raw:
        line_of.append(line)
        line += byte == 10
    out = [0.0] * (line + 1)
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        own = line_of[at:at + n]
        at += n
        if rule == "start":
            out[own[0]] += 1
        elif rule == "end":
            out[own[-1]] += 1
        elif rule == "most":
            out[min(set(own), key=lambda x: (-own.count(x), x))] += 1
        else:
            for x in own:
                out[x] += 1 / n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_byte_by_byte_attribution(spark, rule):
    texts = ["", None, "one line", "a\n\n\n\nb\n  c\n", "é漢\n\n🙂 x\n\n\n", "\n", "x" * 5000, "w  \n \n" * 50]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1)], "doc_id bigint, text string, section int")
    rows = token_counts.counted(docs, rule=rule).collect()
    for i, t in enumerate(texts):
        own = sorted((r.section, r.n_tokens) for r in rows if r.doc_id == i)
        want = _attributed(t or "", rule)
        times = 2 if i == 2 else 1
        assert [n for _, n in own] == pytest.approx([x for x in want for _ in range(times)])
    assert token_counts.counted(docs.where("false")).count() == 0


def test_long_white_space_equals_the_library_where_that_counts_at_all(monkeypatch):
    encoding, _ = token_counts.coder(token_counts.vocabulary())
    r = random.Random(3)
    spaces = [" ", "\t", "\n", "\u3000", "\x85", "\r\n", "\x1c"]
    texts = ["".join(r.choice([r.choice(spaces) * r.randint(1, 40), "word", " x", "12", "é", "'s", "!?"]) for _ in range(r.randint(0, 20)))
             for _ in range(2000)]
    monkeypatch.setattr(token_counts, "_SPACES", token_counts.re.compile(token_counts._SPACES.pattern.replace("4096", "3")))
    for t in texts:
        assert token_counts.encode(encoding, t) == encoding.encode_ordinary(t)
    assert token_counts.encode(encoding, "a" + " " * 300_000 + "b") == encoding.encode_ordinary("a" + " " * 300_000 + "b")


def test_token_counts_of_two_million_characters_without_a_break(spark):
    n = 2_000_000
    rows = [(0, " " * n), (1, "a" + "\t" * n + "b c"), (2, "w" * n), (3, "x\n" + " " * n + "\n" + " " * n)]
    got = {(r.doc_id, r.section): r for r in token_counts.counted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    encoding, _ = token_counts.coder(token_counts.vocabulary())

    def piece(t):
        return len(encoding._encode_single_piece(t))
    assert got[0, 0].n_tokens == piece(" " * n)
    assert got[1, 0].n_tokens == 1 + piece("\t" * (n - 1)) + len(encoding.encode_ordinary("\tb c"))
    assert got[2, 0].n_tokens == len(encoding.encode_ordinary("w" * n))
    assert sum(got[3, s].n_tokens for s in (0, 1, 2)) == got[3, 0].doc_tokens == 1 + piece("\n" + " " * n + "\n" + " " * n)
    with pytest.raises(ValueError):
        token_counts.counted(spark.createDataFrame(rows, "section bigint, text string"), key="section")


def test_sections_add_up_to_the_document(spark):
    from talkframe.llm.queries import queries
    rows = queries()["op8_token_counts"](spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(
        {"n_tokens": "sum", "doc_tokens": "max"}).collect()
    assert len(rows) == 200 and all(r["sum(n_tokens)"] == r["max(doc_tokens)"] for r in rows)


def test_chunk_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_ROWS", 10)
    c = bpe.Coder(bpe.vocabulary())
    texts = pa.array([" ".join(f"word{chr(97 + i % 26)}{'xyz'[i % 3]}!" for i in range(k, k + 30)) for k in range(0, 300, 10)])
    for text, chunks in zip(texts.to_pylist(), list(bpe._chunked(texts, c))):
        assert [int(i) for x in chunks for i in c.cache[x][1].split()] == c.encode(text).ids
