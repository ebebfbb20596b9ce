"""Token files: the encoder against the library, packed planes, and the plan without a broadcast."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuadrante.llm import common, token_files

tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
PATH = str(public.path("word_bpe_49k.json"))


def test_encoder_on_every_character(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 700)  # the table of pieces is renewed over and over
    rng = random.Random(3)
    chars = [chr(i) for i in range(0x250)] + ["'s", "'S", "'ll", "don't", " ", "  ", "\n", "ﬁ", "Σ", "İ", "日", "<|endoftext|>", "</w>", "word"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(600)] + [None, "", " ", "a" * 70_000]
    texts += [chr(i) * 2 + "a" + chr(i) + " " + chr(i) for i in range(0x250)]
    encoder = token_files.Encoder(PATH)
    for first in range(0, len(texts), 100):
        own = texts[first : first + 100]
        ids, ends = encoder.encode(pa.array(own), 2)
        got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in own]
    assert encoder.encode(pa.array([], pa.string()), 2)[0].tolist() == []


def test_a_look_unpacks_few_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    ids = np.random.default_rng(1).integers(0, 5000, 40_000).astype(np.uint32)
    _, _, m = token_files.read_shard(token_files.write_shard([1], np.array([len(ids)]), ids))
    seen = []
    real = pa.decompress
    monkeypatch.setattr(token_files.pa, "decompress", lambda *a, **b: seen.append(1) or real(*a, **b))
    assert m.access(23_456) == ids[23_456] and len(seen) <= 4 * len(m.planes) < sum(len(p.bounds) for p in m.planes) / 10
    v = int(ids[777])
    assert m.count(v) == int((ids == v).sum()) and m.select(v, m.count(v, 777)) == 777 and (m.sequence() == ids).all()


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_repeated_ids_and_the_plan_without_broadcast(spark, broadcast, monkeypatch):
    """A third of the rows have one id; ranges split them, and no id's rows are lost or doubled."""
    monkeypatch.setattr(token_files, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(token_files, "parts", lambda *a: 7)
    rng = random.Random(4)
    rows = [(i if i % 3 else 6, " ".join(rng.choice(["ab", "Cd", "é!", "x1"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, tie string").repartition(3)
    shards = token_files.write_shards(docs, PATH, 2, shard_ids=90)
    assert shards.select("part").distinct().count() == 7
    got = sorted(map(tuple, token_files.read_documents(shards).collect()), key=lambda r: r[1])
    t = tokenizers.Tokenizer.from_file(PATH)
    ids = lambda x: np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((d, len(ids(x)), zlib.crc32(ids(x).tobytes())) for d, x in rows)
    assert [r[0] for r in got] == sorted(r[0] for r in got) and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_no_local_folder_on_a_cluster(spark):
    class Other:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(RuntimeError):
        common.scratch(Other)
