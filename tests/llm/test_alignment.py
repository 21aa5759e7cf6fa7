"""Token alignment against a plain version with the tokenizers' own encoders."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from terradelta.llm import alignment
from terradelta.llm.packing import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """rows: (doc_id, text). Token ranges are compared pair by pair within a group."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_alphabet()
    docs, holds = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append((doc_id, 0, 0, [], []))
            continue
        i = j = x = y = 0
        group = ([], [])
        while i < len(ids_a) or j < len(ids_b):
            if x <= y and i < len(ids_a):
                group[0].append((i, x, x + len(bytes_a[i])))
                x += len(bytes_a[i])
                i += 1
            else:
                group[1].append((j, y, y + len(bytes_b[j])))
                y += len(bytes_b[j])
                j += 1
            if x == y:
                groups.append(group)
                links += [(ids_a[p], ids_b[q]) for p, s, e in group[0] for q, u, v in group[1] if s < v and u < e]
                group = ([], [])
        holds.update(set(links))
        docs.append((doc_id, len(ids_a), len(ids_b), links, [(",".join(str(ids_a[p]) for p, *_ in g), ",".join(str(ids_b[q]) for q, *_ in h)) for g, h in groups]))
    most = defaultdict(int)
    for (p, _), n in holds.items():
        most[p] = max(most[p], n)
    out = Counter()
    for doc_id, n_a, n_b, links, groups in docs:
        text = ";".join("|".join(g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out[(doc_id, n_a, n_b, len(groups), len(links), sum(holds[x] == most[x[0]] for x in links), sum(holds[x] for x in links), digest)] += 1
    return out


@pytest.fixture(scope="module")
def texts(rows):
    more = ["<|endoftext|> <s></s><unk> [PAD] <0x41>", "a\u2581b", "\u2581", "tabs\tand\nlines\r\n\x00\x01", "日本語のテキスト 한국어 \U0001f600\U0001f468\u200d\U0001f469\u200d\U0001f467", "ﬁ ligature ① ½ Å", "  two  spaces   and more    ", "e\u0301 combining", "x" * 50_000, " ", "\n" * 300, "Ünïcödé " * 4000, "http://a.b/c?d=e&f=1234567890"]
    return [(r[0], r[1]) for r in rows] + [(900 + n, x) for n, x in enumerate(more)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, texts, monkeypatch, small):
    if small:  # several slices a batch, blocks of few documents, many flushes
        monkeypatch.setattr(alignment, "CHARS", 700)
        monkeypatch.setattr(alignment, "BLOCK_DOCS", 4)
        monkeypatch.setattr(alignment, "PAIRS", 50)
    docs = spark.createDataFrame([(*r, "k", b"", 1) for r in texts], "doc_id long, text string, keys string, times binary, block int").repartition(3)
    out = alignment.align_documents(docs, A, B)
    assert out.columns == [c.split(" ")[0] for c in alignment.RESULT.split(", ")]
    got = Counter(map(tuple, out.collect()))
    want = brute(texts)
    assert got == want
    assert sum(n for r, n in want.items() if r[1] == 0) >= 5 and max(r[1] for r in want) > 10_000


def test_alignment_of_nothing(spark, nothing):
    assert alignment.align_documents(nothing, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (None, ""), (3, "\u2581")], "doc_id long, text string")
    assert sorted(alignment.align_documents(blank, A, B).collect(), key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_identity_map_keeps_plain_pairs_out_of_the_shuffle(spark):
    docs = spark.createDataFrame([(n, "the end of the world") for n in range(50)], "doc_id long, text string").repartition(2)
    met = alignment.count_pairs(alignment.link_documents(docs, A, B), A, B).collect()
    t = alignment.tokenizers(A, B)
    assert met and all((r.block is None) == (t.same[r.key // t.wide] == r.key % t.wide) for r in met)
    assert sum(r.n for r in met if r.block is None) == 50 * 4
