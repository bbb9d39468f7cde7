"""Alignment and link counts against brute force over the tokenizers and sentencepiece libraries."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from countloom.llm import token_alignment as align, queries
from countloom.llm.bpe import _byte_of_char

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def brute(texts):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    back, rows = _byte_of_char(), []
    for text in texts:
        groups, links = [], []
        a = t.encode(" " + text, add_special_tokens=False) if text else None
        b = sp.encode(text) if text else []
        a_ids = a.ids if text else []
        a_bytes = [bytes(back[c] for c in x) for x in a.tokens] if text else []
        b_bytes = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, sp.encode(text, out_type=str))] if text else []
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            rows.append((a_ids[:0], [], "", []))
            continue
        spans = []
        for part in (a_bytes, b_bytes):
            at, out = 0, []
            for x in part:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(a_ids[i], b[j]) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q] if len(text) < 3000 else None
        if links is None:
            links, j = [], 0
            for i, (p, q) in enumerate(spans[0]):
                while spans[1][j][1] <= p:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][0] < q:
                    links.append((a_ids[i], b[k]))
                    k += 1
        cuts = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        before = 0
        for c in cuts:
            sides = [",".join(str(i) for i, (p, q) in zip(ids, part) if before < q <= c) for ids, part in ((a_ids, spans[0]), (b, spans[1]))] if len(text) < 3000 else None
            if sides is None:
                return None
            groups.append("|".join(sides))
            before = c
        rows.append((a_ids, b, ";".join(groups), links))
    counts, best = Counter(x for r in rows for x in set(r[3])), defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(len(a), len(b), len(g.split(";")) if g else 0, len(x), sum(counts[y] == best[y[0]] for y in x), sum(counts[y] for y in x), g or None) for a, b, g, x in rows]


TEXTS = [
    "a few words", "a few words", None, "", " ", "  two  blanks ", "\n\nlines\n", "<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "日本語 текст 😀😀", "\x00nul\x00", "é" * 50,
    "tab\tand   blank", "x" * 500, "I'll don't 'S 12345", " ", "ﬁ ſ ́ combining", "trailing ", " x",
]


def test_texts(spark):
    rows = [(i, x, "n", 1) for i, x in enumerate(TEXTS)] + [(None, TEXTS[0], "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a int").repartition(3)
    got = align.align(df, A, B)
    assert set(got.columns) == {"doc_id", "text", "block", *NAMES} and got.count() == len(rows)
    want = brute(TEXTS + [TEXTS[0]])
    for r in got.collect():
        assert tuple(r[c] for c in NAMES) == want[-1 if r["doc_id"] is None else r["doc_id"]], r
        assert r["block"] == "n"
    assert align.align(df.limit(0), A, B).count() == 0
    assert align.align(df.where("text is null or text = ''"), A, B).agg({"n_links": "sum", "count_sum": "sum"}).first()[0] == 0


def test_blocks(monkeypatch):
    """One pass in blocks gives the rows in order."""
    import pyarrow as pa

    monkeypatch.setattr(align, "BLOCK", 20)
    batches = [pa.RecordBatch.from_pydict({"text": TEXTS[:5]}), pa.RecordBatch.from_pydict({"text": TEXTS[5:]})]
    blocks = list(align._blocks(iter(batches), 0))
    assert len(blocks) > 3 and [x for b in blocks for x in b.column(0).to_pylist()] == TEXTS


def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE text IS NULL OR length(text) < 3000").fetchall()
    want = brute([t for _, t in docs])
    got = align.align(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text IS NULL OR length(text) < 3000"), A, B).collect()
    by = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in got}
    assert len(got) == len(docs) and all(by[d] == w for (d, _), w in zip(docs, want))
    whole = {r["doc_id"]: r for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert len(whole) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(whole[d]["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") and (whole[d]["n_a"], whole[d]["n_links"]) == (w[0], w[3]) for (d, _), w in zip(docs, want))


def test_other_models_raise(monkeypatch):
    class Odd(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 300 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        align.Pair(A, B)


def test_units_remembered_are_bounded_by_bytes(monkeypatch):
    """Few long units weigh as much as many short ones."""
    monkeypatch.setattr(align, "UNIT_BYTES", 1 << 20, raising=False)
    pair, sp = align.Pair(A, B), sentencepiece.SentencePieceProcessor(model_file=B)
    texts = [f"{i}-" + "xyz" * 10_000 for i in range(60)] + ["1-" + "xyz" * 10_000, "a few words", "a few c▁d words", "two a"]
    for x in texts:
        ids = pair.encode_b([x])[0].tolist()
        assert ids == ([] if "▁" in x else sp.encode(x))
        assert sum(len(k) + len(v) for part in (pair.units, pair.older) for k, v in part.items()) < 2 << 20


def test_a_block_is_aligned_in_slices(spark, monkeypatch):
    """A worker holds the tokens of a slice, and what it stores does not depend on the slices; counts come back without lists in the JVM."""
    import pyarrow as pa

    taken = []

    class Taken(Exception):
        pass

    def take(df, run, schema):
        taken.append(run)
        raise Taken

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "collect_list" not in align.align(df, A, B)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(type(df), "mapInArrow", take)
    monkeypatch.setattr(align, "TaskContext", type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": staticmethod(lambda: 0)}))}))
    with pytest.raises(Taken):
        align.align(df, A, B)
    sizes, encode = [], align.Pair.encode_a
    monkeypatch.setattr(align.Pair, "encode_a", lambda pair, texts: sizes.append(sum(map(len, texts))) or encode(pair, texts))
    long = pa.RecordBatch.from_pydict({"doc_id": range(300), "text": [f"{i} some words " * 400 for i in range(300)]})
    assert len(list(taken[0](iter([long])))) == 1 and max(sizes) < 1 << 19
    odd = [pa.RecordBatch.from_pydict({"doc_id": range(len(TEXTS)), "text": TEXTS})] * 2
    whole = list(taken[0](iter(odd)))
    monkeypatch.setattr(align, "SLICE", 20)
    assert len(whole) == 1 and list(taken[0](iter(odd))) == whole
