"""Media chunks, token records, SentencePiece: round trips and comparison with the libraries."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnspark.llm import media_chunks, sentence_pieces, token_records
from tarnspark.llm.common import scratch


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    parts, digests = media_chunks.chunks(data)
    assert b"".join(parts) == data and len(digests) == len(parts)
    assert all(media_chunks.LEAST <= len(p) <= media_chunks.MOST for p in parts[:-1])
    moved, _ = media_chunks.chunks(b"some bytes before" + data)
    assert len(set(parts) & set(moved)) > 0.8 * len(parts)
    flat, _ = media_chunks.chunks(bytes(100_000))
    assert b"".join(flat) == bytes(100_000) and max(map(len, flat)) <= media_chunks.MOST


def test_media_round_trip(edge_rows, clashing_docs, empty_docs):
    packs, table = media_chunks.write_store(clashing_docs)
    got = Counter((r["doc_id"], r["n_bytes"], hashlib.sha256(r["media"]).hexdigest()) for r in media_chunks.read_store(packs, table).collect())
    want = Counter()
    for r in edge_rows:
        data = (r[1] or "").encode()
        payload = media_chunks.payload_of(data)
        assert len(payload) % 64 == 0 and payload and media_chunks.samples(media_chunks.wav(payload)) == payload
        want[r[0], len(data), hashlib.sha256(media_chunks.wav(payload)).hexdigest()] += 1
    assert got == want
    assert table.count() == table.select("hi", "lo").distinct().count() > 0  # shared chunks are stored once
    assert media_chunks.read_store(*media_chunks.write_store(empty_docs)).count() == 0


def test_media_features(clashing_docs, edge_rows):
    """Every column of the contract against the texts themselves."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    got = Counter(map(tuple, media_chunks.read_store(*media_chunks.write_store(clashing_docs)).mapInArrow(media_chunks._features, schema).collect()))
    want = Counter()
    for r in edge_rows:
        data = (r[1] or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 if data else 64)
        x = [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        media = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        feature = f"sum={sum(x)};min={min(x)};max={max(x)};turns={turns};energy={sum(v * v for v in x)}"
        want[r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature] += 1
    assert got == want


def test_missing_chunks_are_refused(spark):
    docs = spark.createDataFrame([(k, "the same long text of a shared chunk " * 40) for k in range(3)], "doc_id long, text string")
    packs, table = media_chunks.write_store(docs)
    assert media_chunks.read_store(packs, table).count() == 3 and table.count() > 0
    with pytest.raises(Exception, match="not in the chunk table"):
        media_chunks.read_store(packs, table.limit(0)).collect()


def test_damaged_media_is_refused():
    with pytest.raises(ValueError):
        media_chunks.samples(media_chunks.wav(bytes(64))[:-1])


def test_token_records(spark, edge_rows, clashing_docs, empty_docs):
    tokenizer = token_records.Encoder(token_records.tokenizer_path())
    manifest = token_records.write_records(clashing_docs, scratch(spark, "records"), token_records.tokenizer_path())
    got = token_records.read_records(manifest).orderBy("start").collect()
    ids = [np.append(x, 2).astype("<u4") for x in tokenizer.whole([r[1] or "" for r in edge_rows])]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(edge_rows, ids, strict=True))
    starts = [r["start"] for r in got]
    assert starts == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    shard = manifest.filter("records > 1").first()
    doc_id, own = token_records.read_one(shard["path"], shard["index"], 1)
    assert any(r["doc_id"] == doc_id and r["n_tokens"] == len(own) for r in got)
    with pytest.raises(IndexError):
        token_records.read_one(shard["path"], shard["index"], shard["records"])
    assert token_records.read_records(token_records.write_records(empty_docs, scratch(spark, "records"), token_records.tokenizer_path())).count() == 0


def test_damaged_record_is_refused():
    record = bytearray(token_records.framed(token_records.payload(7, np.arange(5), True)))
    assert token_records.unpacked(next(token_records._records(pa.BufferReader(bytes(record)))))[0] == 7
    for k in (0, 9, 20, len(record) - 1):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            next(token_records._records(pa.BufferReader(bytes(bad))))


ODD_TEXTS = ["", " ", "  a   b  ", "x" * 500, "日本語テキスト" * 30 + "😀\x00\t", "\n\n a\n", "é ß½ <s></s> <unk> <0x41>", "1234567890" * 20, "a b c\r\nd", "it's 'll we've <|endoftext|>", "a word, a word. word; word word! (word?) 12. 3, é. ,., .\nword.\nWord, x.y. o'clock. don't, e\u0301. ²."]


@pytest.mark.parametrize("kept", [5, 100_000])
def test_word_table_encoders_equal_the_libraries(edge_rows, kept):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ODD_TEXTS + [r[1] or "" for r in edge_rows]
    own = token_records.Encoder(token_records.tokenizer_path(), kept)
    for _ in range(2):
        for a, b in zip(own.encode(texts), own.whole(texts), strict=True):
            assert a.tolist() == [*b.tolist(), 2]
    plain = Tokenizer.from_file(token_records.tokenizer_path())
    assert [x.tolist() for x in own.encode(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert plain.token_to_id("<|endoftext|>") in own.encode(["it's <|endoftext|> here"])[0].tolist()
    pieces = sentence_pieces.Pieces(sentence_pieces.model_path(), kept)
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    for _ in range(2):
        flat, n = pieces.encode(texts)
        split = np.split(flat, np.cumsum(n)[:-1])
        assert [s.tolist() for s in split] == library.encode(texts)
    assert [pieces.decode(s.tolist()) for s in split] == texts
    assert pieces.decode(pieces.encode(["▁a"])[0].tolist()) == " a"  # U+2581 stands for a space


def test_suffix_array_and_occurrences():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 300).astype(np.uint32)
    order = sentence_pieces.suffix_array(text, 16).tolist()
    keys = [text[k : k + 16].tolist() for k in order]
    assert sorted(order) == list(range(300)) and keys == sorted(keys)
    pieces = sentence_pieces.Pieces(sentence_pieces.model_path())
    word = "▁the▁theatre\x00"
    at, piece = pieces.occurrences(np.frombuffer(word.encode("utf-32-le"), np.uint32))
    chars = ["".join(map(chr, pieces.chars[p, : pieces.size[p]])) for p in piece]
    every = {"".join(map(chr, c[:n])) for c, n in zip(pieces.chars, pieces.size, strict=True)}
    want = [(k, word[k : k + n]) for k in range(len(word)) for n in range(1, 17) if k + n <= len(word) and word[k : k + n] in every]
    assert list(zip(at.tolist(), chars, strict=True)) == want


def test_encoded_frames(edge_rows, clashing_docs, empty_docs):
    out = sentence_pieces.encoded(clashing_docs, sentence_pieces.model_path())
    assert "ids" in out.columns and "text" not in out.columns and out.count() == len(edge_rows)
    back = Counter((r["doc_id"], r["text"]) for r in sentence_pieces.decoded(out.select("doc_id", "ids"), sentence_pieces.model_path()).collect())
    assert back == Counter((r[0], r[1] or "") for r in edge_rows)
    assert sentence_pieces.encoded(empty_docs, sentence_pieces.model_path()).count() == 0
