"""The ten operators against brute force, SQL and the cases that each has to stand."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, bitpack, bpe, jaccard, langid, linededup, lm, packing, syncmers, tokencount, vocabulary

SF = "/root/testdata/sf0.001"
PATH = vocabulary.DEFAULT_VOCABULARY
ALPHABET = ["a", "b", "'", "re", "ll", " ", "  ", "\n", "é", "中", "🙂", "1", "!", "\t", " ", "\x85", "the", "ing", "I'll", "'ve", " "]


def docs(spark, rows, extra=True):
    """(doc_id, text) rows, with columns whose names the results use too."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("doc_id", "'x' AS n_tokens", "text", "1 AS ids", "2 AS id", "'en' AS lang", "3 AS t", "4 AS line", "5 AS _id") if extra else df


ODD = [(1, "one two three"), (2, None), (3, ""), (None, "one two three"), (1, "one two three"), (4, "word " * 30_000), (5, " \n\n \t"), (6, "é中🙂 \u0000x"), (7, "\U0010ffff")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    return con


def against(found, db, sql, key="doc_id"):
    columns = sorted(found.columns)
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert mine == theirs


def some_texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16))) for _ in range(n)]


# 1

@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 24])
def test_packing_of_bits(bits):
    lengths = np.array([0, 1, 63, 64, 65, 3000])
    ids = np.random.default_rng(bits).integers(0, 1 << bits, lengths.sum()).astype(np.uint64)
    ends = np.cumsum(lengths)
    for packed, end, n in zip(bitpack.pack(ids, lengths, bits), ends, lengths):
        own = ids[end - n : end]
        assert len(packed) == -(-n * bits // 8)
        assert (bitpack.unpack(packed, bits, 0, n) == own).all()
        assert (bitpack.unpack(packed, bits, n // 3, n // 2) == own[n // 3 : n // 2]).all()


def test_packed_tokens(spark, documents, texts):
    library = vocabulary.library_encoder(PATH)
    for r in bitpack.packed_tokens(documents).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.bits, len(r.block_offsets)) == (len(ids), 16, -(-len(ids) // bitpack.BLOCK))
        assert bitpack.unpack(r.packed, r.bits, 0, r.n_tokens).tolist() == ids
        if len(r.block_offsets) > 1:
            assert bitpack.unpack_blocks(r.packed, r.bits, r.n_tokens, r.block_offsets, 1, 2).tolist() == ids[bitpack.BLOCK : 2 * bitpack.BLOCK]


def test_packed_tokens_of_odd_rows(spark):
    rows = bitpack.packed_tokens(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens is None and by[2].packed is None and by[3].n_tokens == 0 and by[3].packed == b"" and by[4].n_tokens >= 30_000
    assert bitpack.packed_tokens(docs(spark, [])).count() == 0


# 2

@pytest.mark.parametrize("data_block", [16384, 150])
def test_neighbours_recall(spark, data_block):
    """Against brute force, every vector a query: one block, and several, whose results have to be merged."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows]), [r.vec_id for r in rows]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    found = {r.vec_id: r for r in ann.nearest_neighbours(df, queries=F.lit(True), data_block=data_block).collect()}
    assert np.mean([len({ids[j] for j in np.argsort(d[i])[:10]} & set(found[v].neighbours)) / 10 for i, v in enumerate(ids)]) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for v in ids:
        assert len(found[v].neighbours) == 10 and found[v].distances == sorted(found[v].distances)
        assert found[v].distances == pytest.approx([float(np.sqrt(d[place[v], place[w]])) for w in found[v].neighbours], rel=1e-4)


def test_neighbours_query(spark):
    from loomgraph.llm import queries

    rows = queries.op2_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert rows and all(r.vec_id % 100 == 0 and len(r.neighbours) == 10 and r.vec_id not in r.neighbours for r in rows)
    assert any(v % 100 for r in rows for v in r.neighbours)


def test_neighbours_of_repeated_vectors_over_blocks(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100 + i, [float(i), 9.0]) for i in range(30)]
    found = {r.vec_id: r for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 3, queries=F.lit(True), data_block=8).collect()}
    assert found[5].neighbours == [0, 1, 2] and found[0].neighbours == [1, 2, 3] and found[5].distances == [0, 0, 0]
    assert sorted(found[110].neighbours[:2]) == [109, 111] and len(found) == 60


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, float("nan")]), (7, [None, 1.0]), (None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("row", F.lit(1)).withColumn("block", F.lit("x")).withColumn("v", F.lit(2))
    found = ann.nearest_neighbours(df, queries=F.lit(True)).collect()
    assert len(found) == len(rows)
    by = {r.vec_id: r for r in found}
    assert by[2].neighbours == [None, 1, 1] and by[2].distances == pytest.approx([1, 2**0.5, 2**0.5])
    assert all(by[i].neighbours is None for i in (3, 4, 5, 6, 7))
    assert ann.nearest_neighbours(df.limit(0)).count() == 0 and ann.nearest_neighbours(df).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id > 3"), queries=F.lit(True)).count() == 4
    one = ann.nearest_neighbours(df.where("vec_id = 2"), queries=F.lit(True)).collect()
    assert len(one) == 1 and one[0].neighbours == []


# 3 and 6

@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_bpe_and_counts_of_strings(name):
    path = f"/opt/tokenizers/{name}.tiktoken"
    library, encode, counts = vocabulary.library_encoder(path), bpe.trie_chunks(path), tokencount.prefix_counts(path)
    for text in some_texts():
        ids = library.encode_ordinary(text)
        assert np.frombuffer(encode.join([text])[0], "<u4").tolist() == ids
        assert np.frombuffer(vocabulary.library_chunks(path).join([text])[0], "<u4").tolist() == ids
        assert bpe.decode_ids(ids, path).decode() == text
        assert tokencount.counts_of(counts.join([text])[0]).tolist() == [len(library.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)]


def test_bpe_of_documents(spark, documents, texts):
    library = vocabulary.library_encoder(PATH)
    rows = bpe.encode_with_check(documents).collect()
    assert all(r.restored and r.ids == library.encode_ordinary(texts[r.doc_id]) for r in rows)
    back = bpe.decode_bpe(bpe.encode_bpe(documents)).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_bpe_of_odd_rows(spark):
    rows = {r.doc_id: r for r in bpe.encode_with_check(docs(spark, ODD)).collect()}
    assert rows[2].ids is None and rows[3].ids == [] and rows[3].restored and rows[4].restored and rows[6].restored
    assert bpe.encode_bpe(docs(spark, [])).count() == 0


def test_token_counts(spark, documents, texts):
    library = vocabulary.library_encoder(PATH)
    rows = tokencount.token_counts(documents, (7, 100)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.n_tokens == len(library.encode_ordinary(text)) == tokencount.tokens_before(r.prefix_deltas, len(text))
        cut = r.fits_100
        assert len(library.encode_ordinary(text[:cut])) <= 100 and cut == tokencount.longest_within(r.prefix_deltas, 100)
        assert cut == len(text) or all(len(library.encode_ordinary(text[:i])) > 100 for i in range(cut + 1, min(len(text), cut + 40)))


def test_token_counts_of_odd_rows(spark):
    rows = {r.doc_id: r for r in tokencount.token_counts(docs(spark, ODD)).collect()}
    assert rows[2].n_tokens is None and rows[2].fits_512 is None and (rows[3].n_tokens, rows[3].fits_512) == (0, 0) and rows[4].fits_512 < rows[4].fits_2048
    assert tokencount.token_counts(docs(spark, [])).count() == 0


# 4

def test_syncmers_by_sql(spark, documents, db):
    against(syncmers.fingerprints(documents), db, syncmers.oracle())


def test_syncmers_brute_force_and_shared_passages(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    k, s = 12, 5
    weights = syncmers.coefficients(s, 1)
    key = lambda t: (sum(ord(c) * w for c, w in zip(t, weights)) % syncmers.P2 * syncmers.MIX + 12345) % (1 << 31)
    rows = {r.doc_id: r for r in syncmers.fingerprints(docs(spark, [(101, passage), (102, "zzz" + passage), *ODD]), k, s).collect()}
    wanted = [i for i in range(len(passage) - k + 1) if min(h := [key(passage[i + j : i + j + s]) for j in range(k - s + 1)]) in (h[0], h[-1])]
    assert rows[101].positions == wanted
    assert set(zip((p + 3 for p in rows[101].positions), rows[101].fingerprints)) <= set(zip(rows[102].positions, rows[102].fingerprints))
    assert rows[3].positions == [] and syncmers.fingerprints(docs(spark, [(1, None)])).first().positions is None
    assert syncmers.fingerprints(docs(spark, [])).count() == 0


# 5

@pytest.mark.parametrize("least_count", [1, 3])
def test_lm_by_sql(spark, monkeypatch, documents, db, least_count):
    """With a least count arcs are missing, and failure arcs are taken. Small blocks have arcs of their own each."""
    monkeypatch.setattr(lm, "BLOCK", 40_000)
    monkeypatch.setattr(lm, "SIDE_BY_SIDE", 15_000)
    against(lm.score_documents(documents, least_count=least_count), db, lm.oracle(least_count=least_count))


def test_lm_of_other_texts_brute_force(spark):
    rng = random.Random(8)
    known = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    asked = ["".join(rng.choice("abcdxyz") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    order, pad = 3, lm.PAD
    counts = {}
    for t in known:
        t = pad * (order - 1) + t
        for i in range(order - 1, len(t)):
            for k in range(1, order + 1):
                g = t[i - k + 1 : i + 1]
                counts[g] = counts.get(g, 0) + 1

    def p(h, c):
        own = [n for g, n in counts.items() if g[:-1] == h]
        shorter = p(h[1:], c) if h else 1 / lm.CODES
        return (counts.get(h + c, 0) + len(own) * shorter) / (sum(own) + len(own)) if own else shorter

    path = lm.train(docs(spark, list(enumerate(known))), order)
    found = {r.doc_id: r.log_probability for r in lm.score_with(docs(spark, list(enumerate(asked))), path, order).collect()}
    for i, t in enumerate(asked):
        t = pad * (order - 1) + t
        assert found[i] == pytest.approx(sum(np.log(p(t[j - order + 1 : j], t[j])) for j in range(order - 1, len(t))), abs=2e-3)


def test_lm_of_many_characters(spark):
    """More than 32,768 different characters, of which five don't fit in one number."""
    text = "".join(map(chr, range(0x3400, 0x3400 + 36_000)))
    table = spark.createDataFrame([(1, text), (2, text[100:900]), (3, "ab" + text[5:9])], "doc_id bigint, text string")
    db = duckdb.connect()
    db.register("documents", table.toPandas())
    against(lm.score_documents(table), db, lm.oracle())


def test_lm_of_odd_rows(spark):
    rows = lm.score_documents(docs(spark, ODD)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[2].log_probability is None and (by[3].log_probability, by[3].perplexity) == (0.0, None) and by[1].perplexity > 1 and by[7].n_characters == 1
    assert lm.score_documents(docs(spark, [])).count() == 0
    assert lm.score_documents(docs(spark, [(1, ""), (2, None)])).count() == 2


# 7

def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df.where("doc_id % 2 = 0"))
    found = langid.identify(df.where("doc_id % 2 = 1"), model).join(df.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.97
    assert langid.keep_identified(df, model).count() >= 0.99 * df.count()


def test_language_brute_force(spark, documents):
    """Shares and decisions against sets of n-grams that are kept as strings."""
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]

    def grams(text):
        t = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text} ")
        return [t[i : i + 4] for i in range(len(t) - 3) if t[i + 1] != " " != t[i + 2]]

    counts, sizes = {}, {}
    for _, t, lang in rows:
        sizes[lang] = sizes.get(lang, 0) + 1
        for g in grams(t):
            own = counts.setdefault(lang, {})
            own[g] = own.get(g, 0) + 1
    counts = {lang: {g: n for g, n in own.items() if n >= max(1, -(-3 * min(sizes[lang], 1500) // 1500))} for lang, own in counts.items()}
    total = {lang: sum(own.values()) for lang, own in counts.items()}
    rival = {}
    for lang, own in counts.items():
        for g, n in own.items():
            rival[g] = max(rival.get(g, 0), (n - n**0.5) / total[lang])
    kept = {lang: {g for g, n in own.items() if n / total[lang] >= 0.2 * rival[g]} for lang, own in counts.items()}
    found = {r.doc_id: r for r in langid.identify(documents, langid.train(documents)).collect()}
    for i, t, _ in rows:
        own = grams(t)
        shares = sorted(((sum(g in k for g in own) / max(1, len(own)), lang) for lang, k in kept.items()), reverse=True)
        assert found[i].n_grams == len(own)
        if own:
            assert found[i].share == pytest.approx(shares[0][0], abs=0.02) and found[i].second == pytest.approx(shares[1][0], abs=0.02)
            if shares[0][0] - shares[1][0] > 0.05 and abs(shares[0][0] - 0.3) > 0.02:
                assert found[i].language == (shares[0][1] if shares[0][0] >= 0.3 else "und")


def test_filters_hold_what_was_added():
    model = langid.Filters(["a", "b"])
    value, _ = langid.ngram_hashes(["some words of the one language"])
    model.add(1, value)
    total, shares = model.shares(["some words of the one language", "", "12 34 !!", "words"])
    assert total.tolist()[1:3] == [0, 0] and shares[0, 1] == 1 and shares[0, 0] < 0.01 and shares[3, 1] > 0.9


def test_language_of_odd_rows(spark):
    df = docs(spark, ODD)
    model = langid.train(df.unionByName(docs(spark, [(i, "plain words of a language here and there") for i in range(30)])))
    rows = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert rows[2].language is None and rows[3].language == "und" and rows[5].language == "und" and rows[1].n_grams > 0
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and not {2, 3, 5} & {r.doc_id for r in kept.collect()}
    assert langid.train(df.limit(0)).languages == [] and langid.identify(df, langid.train(df.limit(0))).count() == len(ODD)


def test_language_of_rare_labels_and_none(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(df, langid.train(df)).join(df.select("doc_id", "lang"), "doc_id")
    assert found.where("language <> lang").count() == 0 and langid.keep_identified(df, langid.train(df)).count() == df.count()
    rare = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    rare = rare.unionByName(spark.createDataFrame([(-1, "kaksi vanhaa miestä istuu hiljaa järven rannalla", "fi")], rare.schema))
    model = langid.train(rare)
    assert model.languages == ["en", "fi"]
    assert [r.language for r in langid.identify(rare.where("doc_id = -1"), model).collect()] == ["fi"]
    assert langid.keep_identified(rare, model).count() == rare.count()
    unlabelled = rare.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled, langid.train(unlabelled)).count() == rare.count()


def test_language_of_many_labels(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40)), f"l{i:03}") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert len(model.languages) == 130 and len(model.tables) == 3
    found = langid.identify(df, model).join(df, "doc_id")
    assert found.where("language = lang AND share > 0.9 AND second < 0.1").count() == 130 and langid.keep_identified(df, model).count() == 130


# 8

def test_lines_brute_force(spark):
    rng = random.Random(5)
    words = "a b c d e f g".split()
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 9, 10]))) for _ in range(6))) for i in range(40)]
    short = ["a line of few words, told", "other line of few words", "ten to five at the station"]
    rows += [(40 + i, "\n".join(rng.choice(short) for _ in range(2))) for i in range(3)]
    for i in range(43, 60):  # near short lines, by characters
        line = list(rng.choice(short))
        at = rng.randrange(len(line))
        line[at : at + 1] = rng.choice([[], ["z"], [line[at], "y"], ["z", "y", "x"]])
        rows.append((i, "".join(line) + "\nten to\nten do"))
    for _ in range(25):  # near lines
        i, j = rng.randrange(40), rng.randrange(40)
        line = rng.choice(rows[i][1].split("\n")).split()
        at = rng.randrange(len(line))
        line[at : at + 1] = rng.choice([[], ["z"], [line[at], "y"]])
        rows[j] = (rows[j][0], rows[j][1] + "\n" + " ".join(line))

    def near(x, y):
        if x == y:
            return True
        if max(len(x), len(y)) < 8:
            x, y = " ".join(x), " ".join(y)
            if min(len(x), len(y)) < 20:
                return False
        elif min(len(x), len(y)) < 8:
            return False
        if abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        longer, shorter = (x, y) if len(x) > len(y) else (y, x)
        return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))

    lines = [(i, n, line.split(), line) for i, t in rows for n, line in enumerate(t.split("\n"))]
    wanted = {}
    for k, (i, n, w, line) in enumerate(lines):
        gone = w and any(near(w, v) for _, _, v, _ in lines[:k] if v)
        if not gone:
            wanted.setdefault(i, []).append(line)
    found = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert found == {i: "\n".join(wanted.get(i, [])) for i, _ in rows}


def test_one_edit():
    rng = random.Random(4)
    for _ in range(500):
        a = [rng.randrange(3) for _ in range(rng.randint(0, 6))]
        b = [rng.randrange(3) for _ in range(rng.randint(0, 6))]
        near = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        near |= any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
        if a != b:
            assert linededup.within_one_edit(np.array(a), np.array(b)) == near


def test_lines_in_very_many_documents(spark):
    """A line of every document, and one that differs in its number alone."""
    rows = [(i, f"terms of use apply to this text as always here\npage {i} of the long report on trade and on industry\nunique line {i} {'x' * i}") for i in range(150)]
    found = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows), count_col="gone").collect()}
    assert found[0].gone == 0 and all(found[i].gone == 2 and found[i].text.startswith("unique") for i in range(30, 150))


def test_lines_with_a_broadcast_and_with_a_shuffle(spark, documents, db):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for bound in ("-1", "10MB"):
            spark.conf.set(name, bound)
            against(linededup.dedup_lines(documents.select("doc_id", "text"), count_col="n_removed"), db, linededup.oracle())
    finally:
        spark.conf.set(name, before)


def test_lines_of_odd_rows(spark):
    df = docs(spark, [*ODD, (8, "one two three\nnew\n\none  two three")])
    out = linededup.dedup_lines(df, count_col="gone")
    assert out.columns == [*df.columns, "gone"]
    rows = out.collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) + 1 and by[2].text is None and by[3].text == "" and by[8].text == "new\n" and by[8].gone == 2 and by[5].text == " \n\n \t"
    assert [r.text for r in rows if r.doc_id == 1] == ["one two three"] * 2
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(df, count_col="ids")


# 9

def check_windows(rows, sizes, capacity):
    seen = {}
    for r in rows:
        assert r.used == sum(r.lengths) <= capacity and len(r.doc_ids) == len(r.starts) == len(r.lengths)
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            seen.setdefault(d, []).append((s, n))
    assert len({r.window_id for r in rows}) == len(rows)
    for d, size in sizes.items():
        at = 0
        for s, n in sorted(seen.pop(d, [])):
            assert s == at
            at += n
        assert at == size
    assert not seen


def test_windows(spark, documents, texts):
    library = vocabulary.library_encoder(PATH)
    sizes = {d: len(library.encode_ordinary(t)) for d, t in texts.items()}
    for parts, merged in ((1, 256), (5, 256), (5, 2)):
        rows = packing.pack_documents(documents.repartition(parts), 256, merged=merged).collect()
        check_windows(rows, sizes, 256)
        assert sum(r.used for r in rows) / (256 * len(rows)) > 0.93


def test_windows_brute_force():
    rng = random.Random(2)
    pieces = [(i, 0, rng.randint(1, 100)) for i in range(300)]
    windows, closed = packing.Windows(100, 4), []
    open_: list[list] = []
    wanted = []
    for p in pieces:
        closed += windows.put(p)
        fitting = [w for w in open_ if sum(x[2] for x in w) + p[2] <= 100]
        if fitting:
            best = max(fitting, key=lambda w: sum(x[2] for x in w))
        else:
            if len(open_) == 4:
                full = max(open_, key=lambda w: sum(x[2] for x in w))
                open_.remove(full)
                wanted.append(full)
            open_.append(best := [])
        best.append(p)
        if sum(x[2] for x in best) == 100:
            open_.remove(best)
            wanted.append(best)
    assert closed == wanted and [w[1] for w in windows.open] == open_
    merged = packing.merge([p for w in open_ for p in w], 100)
    assert sorted(p for w in merged for p in w) == sorted(p for w in open_ for p in w) and all(sum(p[2] for p in w) <= 100 for w in merged)


def test_windows_of_odd_rows(spark):
    rows = packing.pack_documents(docs(spark, ODD), 512).collect()
    ids = [d for r in rows for d in r.doc_ids]
    assert 2 not in ids and 3 not in ids and ids.count(1) == 2 and None in ids and ids.count(4) > 50
    assert packing.pack_documents(docs(spark, [])).count() == 0


# 10

@pytest.mark.parametrize("hot", [jaccard.HOT, 3])
def test_jaccard_by_sql(spark, documents, db, hot):
    against(jaccard.jaccard_join(documents, hot=hot), db, jaccard.oracle())


def classes_of(pairs, ids):
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


@pytest.mark.parametrize(("n", "threshold", "hot"), [(1, 0.5, jaccard.HOT), (1, 0.5, 2), (2, 0.7, 2), (2, 0.7, jaccard.HOT), (3, 0.9, 5)])
def test_jaccard_brute_force(spark, request, monkeypatch, n, threshold, hot):
    """Also where elements are split by bands, and where rows come in many small chunks."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    request.addfinalizer(lambda: spark.conf.set(batch, before))
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(30)]
    rows = []
    for i in range(120):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))

    def grams(t):
        w = t.split()
        m = min(n, len(w))
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}

    sets = {i: grams(t) for i, t in rows}
    wanted = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
    members, pairs = jaccard.jaccard_pairs(docs(spark, rows), n, threshold, hot=hot)
    own = {}
    for r in members.collect():
        own.setdefault(r.representative, []).append(r.doc_id)
    found = {(min(i, j), max(i, j)) for r in pairs.collect() for i in own[r.a] for j in own[r.b]}
    found |= {(i, j) for ids in own.values() for i in ids for j in ids if i < j}
    assert found == wanted
    group = classes_of(wanted, sets)
    rows = jaccard.jaccard_join(docs(spark, rows), n, threshold, hot=hot).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (group[i], sum(i in p for p in wanted)) for i in sets} and len(rows) == len(sets)


def test_jaccard_of_odd_rows(spark):
    rows = [*ODD, (8, "One, two three!"), (9, "..."), (10, "..."), (11, "solo"), (12, "Solo"), (13, "a b c d"), (13, "e f g h"), (14, "e f g h")]
    found = jaccard.jaccard_join(docs(spark, rows)).collect()
    linked = {(1, 1, 1), (8, 1, 1), (9, 9, 1), (10, 9, 1), (11, 11, 1), (12, 11, 1), (13, 13, 1), (14, 13, 1)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in found} == linked | {(i, i, 0) for i in range(2, 8)}
    df = docs(spark, rows).withColumn("_", F.lit(1)).withColumn("class_id", F.lit(2))
    kept = jaccard.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 13, None]
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0 and jaccard.keep_one_of_each_group(docs(spark, [])).count() == 0


def test_jaccard_of_one_hot_text(spark):
    """A third of all rows are copies of one text; half of the rest differ from it by a word."""
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base)) for i in range(200)] + [(200 + i, " ".join([*base[:-1], f"x{i}"])) for i in range(50)] + [(300 + i, f"text of its own {i} y{i} z{i} a{i}") for i in range(50)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, rows), hot=5).collect()}
    assert found[0] == (0, 249) and found[220] == (0, 249) and found[310] == (310, 0)


def test_state_of_more_edges_than_a_sum_of_hashes_holds(spark):
    from loomgraph.llm.shared import state

    star = spark.range(18_000_000).select((F.col("id") + 1).alias("a"), F.lit(0).cast("bigint").alias("b"))
    found = state(star)
    assert found[0] == 18_000_000 and found != state(star.withColumn("b", F.col("a") - 1)) and state(star.limit(0)) == (0, 0)


def test_spanning_keeps_components(spark, monkeypatch):
    from loomgraph.llm import shared

    monkeypatch.setattr(shared, "EDGES", 50)
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    with_edges = lambda e: {tuple(r) for r in shared.components(e).collect()}
    assert with_edges(shared.spanning(df)) == with_edges(df) and shared.spanning(df.limit(0)).count() == 0
    # in a clique, of each so many edges one a node is left
    clique = spark.range(1000).alias("x").join(spark.range(1000).alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    monkeypatch.setattr(shared, "EDGES", 1_000_000)
    assert shared.spanning(clique.coalesce(1)).count() == 999


def test_jaccard_of_one_large_cluster(spark, monkeypatch):
    """Sets of a cluster go to many blocks, in more than one batch each."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SENT", 1000)
    rows = [(i, " ".join(f"w{k}" if k != i % 50 else f"x{i}" for k in range(50))) for i in range(60)]
    sets = [{tuple(t.split()[k : k + 2]) for k in range(49)} for _, t in rows]
    near = [{j for j in range(60) if j != i and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])} for i in range(60)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, rows)).collect()}
    assert found == {i: (0, len(near[i])) for i in range(60)} and min(map(len, near)) > 50


def test_components(spark):
    from loomgraph.llm.shared import components

    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs_.columns, {r.doc_id for r in docs_.select("doc_id").collect()}
    current = docs_
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        current = stage(spark, current, SF)
        assert current.columns == columns
        now = {r.doc_id for r in current.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        ids = now
    texts = {r.doc_id: (r.text, r.n_chars) for r in current.collect()}
    assert all(n == len(t) for t, n in texts.values())
    assert jaccard.jaccard_join(current).where("n_links > 0").count() == 0
    windows = corpus_pipeline.run(spark, SF).collect()
    library = vocabulary.library_encoder(PATH)
    check_windows(windows, {d: len(library.encode_ordinary(t)) for d, (t, _) in texts.items()}, packing.CAPACITY)


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "words of one kind here", "en", "s", 22), (1, "words of one kind here", "en", "s", 22), (2, None, None, None, None), (3, "", "en", None, 0), (None, "words of one kind here", "en", "s", 22)]
    rows += [(10 + i, f"words of one kind here and line number {i} of it " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 40) for i in range(25)]
    rows += [(60, "words of one kind here\n" + "long " * 40_000, "en", "s", 200_023)]
    clash = "3 AS _removed, 4 AS _removed_, 5 AS class_id, 6 AS id, 7 AS n, 8 AS lines, 9 AS row, 10 AS _, 11 AS n_links, 12 AS `a.b`"
    for table in (rows, []):
        current = spark.createDataFrame(table, kind).selectExpr("*", *clash.split(", "))
        columns = current.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            current = stage(spark, current, SF)
            if k < 3:
                assert current.columns == columns
            found = current.collect()
            if table and k < 3:
                assert {10 + i for i in range(25)} <= {r.doc_id for r in found} and (k == 0 or all(r.n_chars == len(r.text) for r in found))
        assert bool(found) == bool(table)
