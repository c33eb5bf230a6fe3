import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing

PATH = packing.vocabulary_path()


def check(rows, wanted):
    """rows: pieces; wanted: (doc_id, ids) of every document, doc_ids unique."""
    at = {d: 0 for d, _ in wanted}
    ids = {d: np.array(i, "<u4") for d, i in wanted}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {d: len(i) for d, i in ids.items()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in ends.values()), "no window needs padding"


def test_pieces_give_the_tokenizers_ids():
    encoder, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "a<|endoftext|>", "x.  <|endoftext|><|endoftext|>  b\n", "<|endoftext|", "c\n<|endoftext|>\n\n d", "", " ", "a  b", "a \n b", "\n a", "x y ", "it's  a  b　 c  d", "\x1c \x1d a\x1c b", "<|endoftext|> a <|endoftext|>", "w" * 300 + " " + "w" * 300, "é ß 123 4,5 --"]
    random.seed(3)
    texts += ["".join(random.choice("ab1 \n\t.,' é\x1c") for _ in range(60)) for _ in range(500)]
    texts += ["".join(random.choice(["ab", "c.", " ", "\n", "é!!", "1", "'s", "--", "\t"]) for _ in range(40)) for _ in range(500)]
    texts += [" ".join(random.choice(["ab", "c.", "d,,", "a\nb", "&&", "x—.", "it's!", "ß#%", "4."]) for _ in range(40)) for _ in range(500)]
    for t, got in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert got.tolist() == plain.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_query_covers_every_id_once(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op5_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    plain = Tokenizer.from_file(PATH)
    check(rows, [(d.doc_id, plain.encode(d.text, add_special_tokens=False).ids + [1]) for d in docs])


@pytest.mark.parametrize("seed", range(4))
def test_packer_on_random_lengths(seed):
    rng = random.Random(seed)
    packer, wanted, rows = packing.Packer(5), [], []
    for k in range(600):
        n = rng.choice([1, 2, rng.randrange(1, 300), rng.randrange(1025, 2048) if seed < 2 else 1500, 2048, rng.randrange(1, 9000)])
        wanted.append((k, [rng.randrange(50_000) for _ in range(n)]))
        packer.add(k, np.array(wanted[-1][1], "<u4"))
        if k % 97 == 0:
            packer.pack()
            rows += packer.flush()
            assert sum(packer.held.values()) < 2 * 2048
    packer.pack(last=True)
    rows += packer.flush()
    names = [c.split()[0] for c in packing.PIECES.split(", ")]
    from collections import namedtuple

    check([namedtuple("P", names)(*r) for r in rows], wanted)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "a b", 8), (2, "a b", 8), (None, "c", 9)], "doc_id long, text string, start long")
    rows = packing.pack_documents(df, PATH).collect()
    assert sum(r.length for r in rows) == 1 + 3 + 3 + 2
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
