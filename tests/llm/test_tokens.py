import random
import struct
import zlib

import numpy as np
import sentencepiece
from fixtures import ROWS, documents

from linkweave.llm import pieces
from linkweave.llm.token_counts import Counter, TokenCount, proof, token_counts
from linkweave.llm.unigram import Codec, Encoder, Unigram, encode_decode

PATH = TokenCount().path


def fuzz(n):
    rnd = random.Random(8)
    return ["".join(rnd.choice("ab the  \n▁ \tzé中🙂<s>") for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = token_counts(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts(documents(spark, [])).count() == 0


def test_counts_of_odd_strings_and_a_small_memory():
    texts = fuzz(3000)
    counter = Counter(TokenCount(remembered=50), proof(PATH))
    assert counter.counts(texts) == [len(x) for x in counter.sp.encode(texts)]
    assert len(counter.known) < counter.most + 100


def slow_best(codec, unit):
    """The best score by trying every split, longest pieces of equal ends last."""
    raw = (pieces.MARK + unit.replace(" ", pieces.MARK)).encode()
    table = {codec.surface[i].replace(b" ", pieces.MARK.encode()): codec.score[i] for i in range(len(codec.score)) if codec.score[i] < 0}
    best = [0.0] + [float("-inf")] * len(raw)
    starts = [i for i in range(len(raw)) if raw[i] & 0xC0 != 0x80] + [len(raw)]
    for j in starts[1:]:
        for i in (s for s in starts if s < j):
            if raw[i:j] in table:
                best[j] = max(best[j], best[i] + table[raw[i:j]])
        i = max(s for s in starts if s < j)
        if raw[i:j] not in table:
            best[j] = max(best[j], best[i] + codec.unknown)
    return best[-1]


def path_score(codec, ids, unit):
    plain = sum(codec.score[i] for i in ids if codec.score[i] < 0)
    text = (pieces.MARK + unit.replace(" ", pieces.MARK))
    known = {s for s in (codec.surface[i].decode("utf-8", "ignore") for i in range(len(codec.score)) if codec.score[i] < 0) if len(s) == 1}
    return plain + codec.unknown * sum(c not in known and c != pieces.MARK for c in text)


def test_viterbi_is_best_and_round_trips():
    codec = Codec(Unigram())
    encoder = Encoder(codec, Unigram(remembered=100))
    for text in fuzz(1500):
        ids = encoder.encode_all([text])[0].tolist()
        assert codec.decode(ids) == text.replace(pieces.MARK, " ")
    for unit in ["hello", "unbelievable", "zé中", "🙂x", "aaaaaaa", "  lead"]:
        ids = codec.best(unit)
        assert abs(slow_best(codec, unit) - path_score(codec, ids, unit)) < 1e-9


def _varint(b, i):
    v = s = 0
    while True:
        v |= (b[i] & 127) << s
        i, s = i + 1, s + 7
        if b[i - 1] < 128:
            return v, i


def _fields(b):
    i = 0
    while i < len(b):
        start = i
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v, b[start:i]


def _length(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def library_unigram(codec):
    """The library's own unigram encoder with the codec's scores: the model file with two fields changed."""
    out, n = b"", 0
    for number, value, raw in _fields(open(PATH, "rb").read()):
        if number == 1:
            inner = dict((k, v) for k, v, _ in _fields(value))
            body = b"\x0a" + _length(len(inner[1])) + inner[1] + b"\x15" + struct.pack("<f", codec.score[n])
            body += b"\x18" + _length(inner[3]) if inner.get(3, 1) not in (1, 4) else b""
            raw = b"\x0a" + _length(len(body)) + body
            n += 1
        elif number == 2:
            body = b"".join(b"\x18\x01" if k == 3 else r for k, _, r in _fields(value))
            raw = b"\x12" + _length(len(body)) + body
        out += raw
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_encoding_equals_the_librarys_unigram_but_for_ties():
    codec = Codec(Unigram())
    encoder, library = Encoder(codec, Unigram(remembered=1000)), library_unigram(codec)
    words = [w for _, t in ROWS if t for w in t.split(" ")[:200] if pieces.MARK not in w]
    for w in words:
        ours, theirs = encoder.encode_all([w])[0].tolist(), library.encode(w)
        total = lambda ids: sum(codec.score[i] for i in ids)
        assert ours == theirs or abs(total(ours) - total(theirs)) < 1e-4


def test_documents_round_trip(spark):
    rows = encode_decode(documents(spark), with_text=True).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == sorted((str(i), (t or "").replace(pieces.MARK, " ")) for i, t in ROWS)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}i", *r.ids)) for r in rows)
    assert encode_decode(documents(spark, [])).count() == 0


def test_units_side_by_side_equal_units_alone():
    codec = Codec(Unigram())
    units = sorted({u for t in fuzz(400) for u in pieces.units(t)} | {"", " ", "x" * 300, "\U0001f642" * 9, "\x00", "na\u00efve"})
    raws = [(pieces.MARK + u.replace(" ", pieces.MARK)).encode() for u in units]
    assert [np.frombuffer(x, "<i4").tolist() for x in codec.best_many(raws)] == [codec.best(u) for u in units]


def test_long_unspaced_texts_are_not_remembered():
    texts = [chr(0x4E00 + i % 5000) * 50 + str(i) * 2000 for i in range(60)] + ["short words stay"]
    counter = Counter(TokenCount(), proof(PATH))
    assert counter.counts(texts) == [len(x) for x in counter.sp.encode(texts)]
    assert max(map(len, counter.known)) <= TokenCount().unit_chars and "words" in counter.known
    codec = Codec(Unigram())
    encoder = Encoder(codec, Unigram())
    got = encoder.encode_all(texts)
    assert [codec.decode(x.tolist()) for x in got] == texts and max(map(len, encoder.known)) <= Unigram().unit_bytes
