import zlib
from collections import defaultdict

import numpy as np

from foliospark.llm.packing import CachedTokenizer, op10_packing, packed, plan, public_tokenizer

TEXTS = ["", None, "a", "a  b", " \n x", "a\n\n b", "x\t y  z", "　w", "it's  <|endoftext|> 12 34", "word " * 3000, "\n", " ", "  ", "é" * 5000, "  a", "end \n", "a \x85b", "it's we'll, l'été x²y 3½ ٣ a—b …c\u00a0d e\u200bf g\x1ch", "a.\nB c,\n\nd e \nf \n g", "x\ny\n", " \na", "q\n r", "\n\nz", "ab  \ncd"]


def check(rows, texts):
    tokenizer = CachedTokenizer(public_tokenizer())
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(parts) == set(texts)
    for doc, text in texts.items():
        ids = tokenizer.ids(text or "") + [1]
        at = 0
        for r in sorted(parts[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = [sum(r.length for r in own) for own in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    return padding / (sum(used) + padding)


def test_edge_texts(spark):
    texts = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, length int")
    check(packed(df, public_tokenizer()).collect(), texts)


def test_query_packs_tightly(spark):
    data = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert check(op10_packing(spark, data).collect(), texts) < 0.02


def test_repeated_rows_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")] * 40 + [(None, None)] * 3, "doc_id long, text string")
    out = packed(df, public_tokenizer()).collect()
    assert len(out) == 43 and len({(r.sequence_id, r.offset) for r in out}) == 43
    assert packed(df.limit(0), public_tokenizer()).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for scale in (1, 50):
        h = np.bincount(rng.integers(1, 129, 500 * scale), minlength=129)
        runs = plan(h, 128)
        assert (np.bincount(runs[:, 0], weights=runs[:, 2], minlength=129) == h).all()
        fill = defaultdict(int)
        for length, _, n, first, offset in runs:
            for s in range(first, first + n):
                assert fill[s] == offset
                fill[s] += length
        assert max(fill.values()) <= 128 and sum(fill.values()) / (128 * len(fill)) > 0.97


def test_added_tokens_are_what_the_tokenizer_makes_of_them(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizer())
    mark = tokenizer.id_to_token(50256)
    texts = ["x <|endoftext|> y", mark, mark * 3 + "a", f"  {mark}\n b  {mark}", f"it's{mark}we'll", "<|endoftext", "<|endoftext|", " ".join(["word"] * 3000 + [mark, "é"])]
    out = defaultdict(list)
    for r in packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizer()).collect():
        out[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert CachedTokenizer(public_tokenizer()).ids(text) + [1] == ids
        for r in out[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        assert sum(r.length for r in out[i]) == len(ids)
