import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from changelens.llm import packing
from changelens.llm.packing import pack_documents, plan


def place(counts, capacity):
    ranges, total = plan(counts, capacity)
    keys = ranges[:, 0] * (1 << 45) + ranges[:, 1]
    bins = defaultdict(list)
    for s, n in counts.items():
        for r in range(n):
            row = ranges[np.searchsorted(keys, s * (1 << 45) + r, side="right") - 1]
            q = r - row[1]
            bins[int(row[2] + q // row[3])].append((int(row[4] + q % row[3] * s), s))
    return bins, total


def test_plans_are_tight_and_gapless():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 50, 4096])
        counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), 1]) for _ in range(rng.randint(0, 200)))
        bins, total = place(counts, capacity)
        assert sorted(bins) == list(range(total))
        for b in bins.values():
            at = 0
            for o, s in sorted(b):
                assert o == at
                at += s
            assert at <= capacity
            assert sum(3 * s > capacity for _, s in b) <= 2
        bound = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
        assert total <= bound * 1.23 + 1


def test_large_items_are_matched():
    bins, total = place({6: 2, 4: 2, 5: 3}, 10)
    assert total == 4


def test_documents(make_docs, odd_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = pack_documents(make_docs(odd_rows), with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert pack_documents(make_docs([])).count() == 0


def test_remembered_words_give_the_tokenizer_s_ids(monkeypatch):
    """Whole texts by the tokenizer itself, against words that are remembered, forgotten, and cut into letters and marks."""
    monkeypatch.setattr(packing, "_REMEMBERED", 20_000)
    monkeypatch.setattr(packing, "_SLICE", 3_000)
    rng = random.Random(5)
    letters = [chr(c) for c in range(1, 0x180)] + list(" ,.!?;:#$'") * 10 + list("́̂KΣς漢")
    texts = [None, "", " \n", "don't can't's 4,5 <|endoftext|> a<|startoftext|>b", "a\x00b  c\x1cd", "İstanbul é ΣΑΣ.", "x" * 9000 + " " + "!#$" * 2000, "漢字" * 500]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    own = packing.Encoder(None)
    for _ in range(2):
        got = list(own.encode(pa.array(texts, pa.string())))
        assert [x.tolist() for x in got] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(own.encode(pa.array([], pa.string()))) == [] and len(own.words) < 2000
