"""Problems 6 to 8 against the tokenizer's own library, item-by-item packing and the Unicode database."""

import base64
import bisect
import collections
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from edgeloom.llm import lookalike, packing, queries, tokenize


def library(name="byte_bpe_50k"):
    import tiktoken

    with open(f"{tokenize.TOKENIZERS}/{tokenize.FILES[name]}", "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, tiktoken.Encoding("whole", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


ODD = [" ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", "'", "''", "'s", "'re", "'ll", "'LL", "a", "the", "Zü", "é", "é", "漢", "字", "かな", "слово",
       "1", "23", "٣", "!", "?!", "--", " ", "　", " ", "\u0085", "\x1c", "​", "🚧", "👩‍🔬", "_", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_fragments_encode_like_whole_texts(name):
    raw, whole = library(name)
    r = random.Random(11)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(0, 14))) for _ in range(20_000)] + [None, "", "a" * 5000, "漢" * 3000, " " * 3000]
    ids, off = tokenize.RankEncoder(raw).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == whole(t or ""), repr(t)


def test_ids_of_documents(spark, sf_dir):
    _, whole = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.p6_ids(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == whole(texts[r.doc_id] or "")


def test_ids_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "x", 7), (None, "y", 8)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in tokenize.encode_documents(df).collect()), key=repr)
    assert got == [(1, []), (2, [87]), (2, []), (None, [88])]
    assert tokenize.encode_documents(df.limit(0)).count() == 0
    for name in ("word_bpe_49k", "piece_bpe_32k"):
        n = {r.doc_id: r.n_tokens for r in tokenize.count_tokens(df.where("doc_id = 1 or text = 'x'"), tokenizer=name).collect()}
        assert n[1] == 0 and n[2] >= 1


# ---- 7 -------------------------------------------------------------------------------------------------------------

def one_by_one(sizes, capacity):
    """Best-fit decreasing, one item at a time."""
    left, bins = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(left, s)
        if i < len(left):
            r = left.pop(i)
        else:
            r, bins = capacity, bins + 1
        bisect.insort(left, r - s)
    return bins, sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_packs_like_item_by_item(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 64, 512])
    sizes = [r.choice([r.randint(1, capacity), min(capacity, 1 + int(r.expovariate(8 / capacity)))]) for _ in range(r.choice([0, 1, 50, 3000]))]
    steps, n = packing.best_fit_plan(collections.Counter(sizes), capacity)
    load, seen = collections.Counter(), collections.Counter()
    by_size = collections.defaultdict(list)
    for s in sorted(steps):
        by_size[s[0]].append(s)
    for s in sizes:
        rank = seen[s]
        seen[s] += 1
        _, first_rank, each, first = [x for x in by_size[s] if x[1] <= rank][-1]
        load[first + (rank - first_rank) // each] += s
    bins, left = one_by_one(sizes, capacity)
    assert (n, sorted(capacity - load[b] for b in range(n))) == (bins, left)


def test_tightest_against_search():
    r, t, on = random.Random(2), packing.Tightest(100), set()
    for _ in range(3000):
        x = r.randrange(101)
        (on.add if r.random() < 0.5 else on.discard)(x)
        t.set(x, x in on)
        y = r.randrange(101)
        assert t.first_from(y) == min((z for z in on if z >= y), default=None)


def test_pack_places_every_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_GROUP", 100)
    r = random.Random(4)
    sizes = [r.choice([0, 0, 0, 5, 5, 5, None, r.randrange(40), r.randrange(400)]) for _ in range(1000)]
    df = spark.createDataFrame([(i, s, "x", "y") for i, s in enumerate(sizes)], "doc long, n int, item string, salt string")
    for capacity in (16, 100):
        got = packing.pack(df, {1: capacity}, "doc", "n").collect()
        per, load = collections.defaultdict(list), collections.Counter()
        for x in got:
            per[x.item].append((x.piece, x.tokens))
            load[x.container] += x.tokens
        assert len(per) == len(sizes) and max(load.values()) <= capacity
        for i, s in enumerate(sizes):
            pieces = [t for _, t in sorted(per[i])]
            assert sum(pieces) == (s or 0) and all(t == capacity for t in pieces[:-1]) and len(pieces) == max(1, -(-(s or 0) // capacity))
        assert len(load) == one_by_one([t for p in per.values() for _, t in p if t], capacity)[0]
        assert sorted(load) == list(range(len(load)))
    assert packing.pack(df.limit(0), {1: 5}, "doc", "n").count() == 0
    assert {x.container for x in packing.pack(df.where("n = 0"), {1: 5}, "doc", "n").collect()} == {0}


def test_containers_of_documents(spark, sf_dir):
    caps = {r.size_id: r.capacity_tokens for r in spark.read.parquet(f"{sf_dir}/pack_sizes.parquet").collect()}
    got = queries.p7_containers(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    load = collections.Counter()
    for r in got:
        load[r.size_id, r.container_id] += r.tokens
    assert {s for s, _ in load} == set(caps) and all(v <= caps[s] for (s, _), v in load.items())
    assert all(len({r.doc_id for r in got if r.size_id == s}) == docs for s in caps)
    for r in queries.p7_fill(spark, sf_dir).collect():
        assert r.fill > 0.9 or r.containers <= 2 or r.tokens > (r.containers - 1) * caps[r.size_id] * 0.9


# ---- 8 -------------------------------------------------------------------------------------------------------------

ALIKE = lookalike.LOOKALIKES


def by_database(text):
    out = []
    for ch in text:
        how = unicodedata.decomposition(ch)
        if unicodedata.category(ch) == "Cf" and ord(ch) not in lookalike._SEEN_FORMAT:
            continue
        if unicodedata.category(ch) == "Zs":
            ch = " "
        elif how.startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")) or how.startswith(("<initial>", "<medial>", "<final>", "<isolated>")) and how.count(" ") == 1:
            ch = "".join(chr(int(x, 16)) for x in how.split()[1:])
        elif ch in "ﬀﬁﬂﬃﬄﬆĲĳǇǈǉǊǋǌǱǲǳ" or unicodedata.category(ch) == "Nl" and how.startswith("<compat>"):
            ch = unicodedata.normalize("NFKC", ch)
        out.append(ch)
    s = "".join(ALIKE.get(x, x) for x in unicodedata.normalize("NFD", "".join(out)))
    return unicodedata.normalize("NFC", s)


CHARS = [0x300, 0x301, 0x308, 0x323, 0x327, 0x328, 0x345, 0x5B0, 0x3099, 0x65, 0x41, 0x435, 0x438, 0x410, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xAC01, 0x9C7, 0x9BE,
         0x9D7, 0xDC6, 0xDD9, 0xDCF, 0xDCA, 0x1E9B, 0x212B, 0xFF76, 0xFF9E, 0xFF41, 0xA0, 0x20, 0x3000, 0x200B, 0xAD, 0x2011, 0x1EE5, 0x1D15E, 0x344, 0xFB1D, 0xF73, 0xB2,
         0x1D400, 0x1D7D8, 0x2168, 0x217F, 0xFB03, 0x17F, 0x1C6, 0x1C8, 0xFE8F, 0xFEFB, 0x3B1, 0x3BD, 0x131, 0x13AA, 0xA4D0, 0x2460, 0x3F5, 0x210C]


def test_forms_match_the_database():
    r = random.Random(9)
    texts = ["".join(chr(r.choice(CHARS)) for _ in range(r.randrange(0, 10))) for _ in range(30_000)] + [None, "", "e" + "́" * 500, "plain ascii\r\n\t"]
    for t, c in zip(texts, lookalike.canonical(pa.array(texts)).to_pylist()):
        assert c == (None if t is None else by_database(t)), ascii(t)


def pairs_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_of_documents(spark):
    d = "/root/testdata/sf0.01"
    groups = collections.defaultdict(list)
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        if r.text and by_database(r.text).strip():
            groups[by_database(r.text)].append((r.doc_id, r.text))
    want = sorted((min(a, b), max(a, b)) for g in groups.values() for i, (a, s) in enumerate(g) for b, t in g[:i] if s != t)
    assert pairs_of(queries.p8_found(spark, d)) == want and want
    classes = {r.doc_id: r.class_id for r in queries.p8_classes(spark, d).collect()}
    assert classes == {i: min(x for x, _ in g) for g in groups.values() if len({t for _, t in g}) > 1 for i, _ in g}


def test_pairs_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "GROUP", 3)
    long = "wort é " * 20_000
    texts = ["аbс", "abc", "ａbc", "abc", "Abc", None, None, "", " ", " ", "​", "café", "café", "cafe", "x y", "x y", "x  y", "x\ny", "2²", "22", long, long.replace("é", "é")]
    df = spark.createDataFrame([(i, t, "f", "r") for i, t in enumerate(texts)], "doc_id long, text string, form string, raw string")
    want = sorted((a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] and texts[b] and texts[a] != texts[b]
                  and by_database(texts[a]) == by_database(texts[b]) and by_database(texts[a]).strip())
    assert pairs_of(lookalike.agreeing_pairs(df)) == want
    assert (0, 1) in want and (11, 12) in want and (14, 15) in want and (20, 21) in want
    assert lookalike.agreeing_pairs(df.limit(0)).count() == 0
    assert [r.text for r in lookalike.canonical_texts(df.where("doc_id in (2, 5)")).orderBy("doc_id").collect()] == ["abc", None]


def test_nothing_is_shared_between_texts():
    a = lookalike.canonical(pa.array(["e", "́x", "ᄀ", "ᅡ"])).to_pylist()
    assert a == ["e", "́x", "ᄀ", "ᅡ"]
    assert np.array_equal(lookalike.table().mark[[0x301, 0x65]], [230, 0])


def test_letters_beyond_the_planted_ones():
    """Whole ranges by rule, the letters of the list, and what must stay different."""
    def form(*texts):
        return lookalike.canonical(pa.array(texts)).to_pylist()

    assert form("ναïve", "ıdea", "ᎪᏢ", "𝐛𝑜𝔩𝕕 𝟘", "Ⅻ ⅳ", "ﬁnal oﬃce", "ﺑ", "Ⲟⲟ", "ꓡꓲꓢꓴ") == ["vaïve", "idea", "AP", "bold 0", "XII iv", "final office", "ب", "Oo", "LISU"]
    for ch in map(chr, [*range(0x1D400, 0x1D800), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07)]):
        want = unicodedata.normalize("NFKC", ch)
        if want.isascii() and want.isalnum() and ch != "ſ" and ch != "ﬅ":
            assert form(ch) == [want], ascii(ch)
    same = ["ſ", "①", "²", "ﬅ", "½", "㎏", "ß", "ł", "№"]
    assert form(*same) == same


def test_confusables_of_a_file(spark, tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# table\n0431 ;\t0036 ;\tMA # digit\n0433 ;\t0072 ;\tMA # r\n0448 ;\t0057 0057 ;\tMA\n00E9 ;\t0065 ;\tMA # decomposes\n2019 ; 0027 ; MA\nx\n\n")
    letters = lookalike.read_confusables(str(f))
    assert letters == {"г": "r", "ш": "WW"}
    df = spark.createDataFrame([(1, "гo"), (2, "ro"), (3, "é’б"), (4, "ш"), (5, "а")], "doc_id long, text string")
    assert [r.text for r in lookalike.canonical_texts(df, alike=letters).orderBy("doc_id").collect()] == ["ro", "ro", "é’б", "WW", "а"]
    assert pairs_of(lookalike.agreeing_pairs(df, alike=letters)) == [(1, 2)] and pairs_of(lookalike.agreeing_pairs(df)) == []


def test_every_token_is_placed_once(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/pack_sizes.parquet").count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = queries.p7_conserved(spark, sf_dir).collect()
    assert len(got) == sizes and all((r.documents, r.changed, r.over) == (docs, 0, 0) for r in got)
