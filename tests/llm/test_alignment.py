"""The alignment against whole texts under both libraries."""

import hashlib
import re
from collections import Counter

import pandas as pd
import public_tokenizers as public
import pytest
from siltstone.llm import alignment as module
from siltstone.llm.alignment import Aligner, alignment, ends_together
from siltstone.llm.token_counts import _bytes_of_characters

FILES = public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def tokens(libraries, text):
    """(ids, end offsets) of either side, or None."""
    a, b = libraries
    table, out = _bytes_of_characters(), []
    own = a.encode(" " + text, add_special_tokens=False).ids
    for ids, pieces in ((own, [bytes(table[c] for c in a.id_to_token(i)) for i in own]), (b.encode(text), None)):
        pieces = pieces or [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", b.id_to_piece(i))) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if b"".join(pieces) != b" " + text.encode():
            return None
        ends, at = [], 0
        for p in pieces:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain(libraries, texts):
    found, counts = [], Counter()
    for i, text in texts:
        both = tokens(libraries, text) if text else None
        if both is None:
            found.append((i, 0, 0, [], []))
            continue
        (a, a_ends), (b, b_ends) = both
        common = sorted(set(a_ends) & set(b_ends))
        groups, links, before = [], [], 0
        for end in common:
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends, strict=True) if before < e <= end) for ids, ends in both))
            links += [(x, y) for x, e in zip(a, a_ends, strict=True) if e == end for y, f in zip(b, b_ends, strict=True) if f == end]
            before = end
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return Counter((i, n_a, n_b, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if k else "") for i, n_a, n_b, g, k in found)


AWKWARD = [
    None, "", " ", "  two  spaces ", "a", "<|endoftext|>x <|endoftext|>", "<0x0A> <0x41>", "line\nnext \n end", "tab\tx y  z", "日本語 テキスト ΑΣ", "▁ mark", "a▁b c", "é ́x", "emoji 👩‍👩‍👧 👍🏽!",
    "it's we'll 'S 123 4567 x1y", "word " * 3000, "x" * 5000, "\x00 nul \x7f", "trailing \n", "　wide　space a", "<s> </s> <unk>", "ﬁ ½ é É", "a\x1cb c\x0bd \x85e\x1f", "'''s 've're x'LL", "".join(map(chr, range(128))), " ".join(map(chr, range(33, 127))),
]


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("stretch", [8 << 20, 500])
def test_against_whole_texts(spark, libraries, monkeypatch, stretch):
    monkeypatch.setattr(module, "STRETCH_BYTES", stretch)
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [*enumerate(AWKWARD), *((1000 + int(i), t) for i, t in zip(docs.doc_id[:120], docs.text[:120], strict=True)), (None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, "p", 1, [1]) for i, t in texts], "doc_id long, text string, stretch string, pairs int, times array<int>").repartition(3)
    assert rows_of(alignment(df, *FILES)) == plain(libraries, texts)
    assert alignment(df.limit(0), *FILES).count() == 0
    assert rows_of(alignment(df.where("doc_id IN (0, 1)"), *FILES)) == Counter({(0, 0, 0, 0, 0, 0, 0, ""): 1, (1, 0, 0, 0, 0, 0, 0, ""): 1})


def test_texts_are_cut_and_units_forgotten(monkeypatch, libraries):
    monkeypatch.setattr(module, "REMEMBERED", 2000)
    aligner = Aligner(*FILES)
    assert aligner.cuts and aligner.cut("a b  c\n d é f") == ["a", "b  c\n d", "é", "f"]
    for text in [" ".join(f"w{i}" for i in range(300)), *filter(None, AWKWARD)]:
        found, both = aligner.text(text), tokens(libraries, text)
        assert (found is None) == (both is None)
        if found:
            assert found[:2] == (len(both[0][0]), len(both[1][0]))


def test_tokens_without_bytes_end_with_those_before_them():
    a, b = {1: 1, 2: 1, 3: 3, 4: 0}, {7: 1, 8: 1, 9: 3, 6: 0}
    found = list(ends_together([1, 2, 4, 3], [7, 8, 9, 6], a, b, [2, 5]))
    assert found == [(3, 2, ["1|7", "2,4|8"], [(1, 7), (2, 8), (4, 8)]), (1, 2, ["3|9,6"], [(3, 9), (3, 6)])]
    assert list(ends_together([1, 3], [9, 7], {1: 1, 3: 3}, {9: 3, 7: 1}, [4])) == [(2, 2, ["1,3|9,7"], [(3, 7)])]
