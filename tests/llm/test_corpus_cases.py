"""Edge cases and small brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, exact_dedup, orc_output, packing, pii, quality, secrets, sharding, simhash, urls
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_hash string, digest string, bucket int, shard int, model int"
LONG = "abc de " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named as operators name theirs."""
    rows = [(1, "One two  three", "en"), (1, "One two  three", "en"), (2, "One two three", "en"), (None, "lost id here", None), (3, None, "fr"), (4, "", None), (5, LONG, "en"), (6, LONG + "x", "en")]
    return spark.createDataFrame([(i, t, lang, None, None, "x", "y", 1, 2, 3) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", "abc de abc de"), ("b", None), (None, "lost id here"), ("c", "")], "item_id string, text string")


def test_odd_rows_pass_every_operator(spark, odd, none, items, tmp_path):
    import public_tokenizers

    labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs, n in ((odd, 8), (none, 0)):
        assert exact_dedup.deduplicated(docs).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert decontamination.contamination(docs, items).count() == n
        assert pii.personal_data(docs).count() == n
        laid = sharding.numbered(sharding.assigned(docs.select("doc_id", F.col("shard").alias("extra")), "doc_id", [1.0, 2.0]), "doc_id", 2).toPandas()
        assert len(laid) == n and all(sorted(g.slot) == list(range(len(g))) for _, g in laid.groupby("shard"))
        pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit("x").alias("host"), F.lit("y").alias("tokens"), F.lit("z").alias("rule"))
        assert urls.judged_urls(pages, labels).where("verdict = 'allow'").count() == n
        assert secrets.secrets_in(docs).count() == n
        assert quality.judged(docs, labels).where("keep").count() == n
        packed = packing.documents_packed(docs)
        assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
        out = str(tmp_path / f"orc{n}")
        orc_output.write_ids(docs, out, path)
        assert orc_output.file_digests(orc_output.read_ids(spark, out)).count() == n
        assert exact_dedup.one_of_each(docs).count() == (5 if n else 0)
        assert exact_dedup.one_of_each(docs).columns == docs.columns


def test_exact_ties(odd):
    rows = {(r["doc_id"], r["group_size"], r["keep_id"], r["kept"]) for r in exact_dedup.deduplicated(odd).collect()}
    assert (1, 3, 1, True) in rows and (2, 3, 1, False) in rows and (3, 2, 3, True) in rows and (4, 2, 3, False) in rows


def test_cuckoo_filter_inserts_grows_and_deletes():
    r = random.Random(3)
    keys = [r.randbytes(32) for _ in range(5000)]
    bucket = exact_dedup.Bucket(10)
    for k in keys:
        bucket.add(k, 0)
    assert bucket.filter.slots > 100 and all(bucket.find(k) == 0 for k in keys)
    assert all(bucket.remove(k) for k in keys[:2500])
    assert not any(bucket.find(k) == 0 for k in keys[:2500]) and all(bucket.find(k) == 0 for k in keys[2500:])


def test_index_of_live_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 10)
    best = F.struct(F.lit(-3).alias("shorter"), F.lit(False).alias("no_id"), F.col("id").alias("doc_id")).alias("best")
    digests = spark.range(300).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id", best, F.lit(1).cast("long").alias("group_size"))
    index = exact_dedup.build_index(digests.where("id < 100"), 8)
    changes = digests.where("id >= 50").withColumn("live", F.col("id") >= 100)
    index, buckets = exact_dedup.update_index(index, changes, 8)
    assert buckets == 25 and index.where("size(digests) > 60").count() == 0
    known = exact_dedup.probe_index(index, digests, buckets).join(digests, "digest")
    assert {r["id"] for r in known.where("known").collect()} == {*range(50), *range(100, 300)}
    again = digests.where("id < 2").withColumn("best", F.struct(F.lit(-9).alias("shorter"), F.lit(False).alias("no_id"), F.lit(7).cast("long").alias("doc_id")))
    both = again.withColumn("live", F.lit(False)).where("id = 0").unionByName(again.withColumn("live", F.lit(True)))
    index, buckets = exact_dedup.update_index(index, both, buckets)
    got = {r["digest"]: (r["best"]["doc_id"], r["group_size"]) for r in exact_dedup.entries_of(index).collect()}
    of = {r["id"]: r["digest"] for r in digests.collect()}
    assert got[of[0]] == (7, 1) and got[of[1]] == (7, 2) and got[of[2]] == (2, 1) and len(got) == 250


@pytest.mark.parametrize("plan", (simhash.THREE, simhash.TWO))
def test_anchors_meet_every_near_pair(plan):
    r = random.Random(5)
    blocks, coded, reach = plan
    for _, bits in blocks:
        near, home = simhash.block_patterns(bits, coded, reach)

        def syndrome(w):
            s = 0
            for i in range(coded):
                s ^= (w >> i & 1) * (i + 1)
            return s

        for _ in range(200):
            x = r.getrandbits(bits)
            y = x
            for i in r.sample(range(bits), reach):
                y ^= 1 << i
            assert x ^ home[syndrome(x)] in {y ^ p for p in near[syndrome(y)]}


def test_links_of_full_anchors_and_clusters(spark):
    assert simhash.layout(1000) == simhash.THREE and simhash.layout(1 << 30) == simhash.TWO
    r = random.Random(6)
    centre = r.getrandbits(64)
    fps = list({centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(600)} | {r.getrandbits(64) for _ in range(300)})
    signed = np.array(fps, np.uint64).view(np.int64)
    classes = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    want = len({frozenset(c) for c in _clusters(np.array(fps, np.uint64))})
    for rows, plan in ((10**6, None), (50, None), (10**6, simhash.TWO), (50, simhash.TWO)):
        got = components(simhash.links(classes, rows, plan))
        assert got.select("component").distinct().count() + len(fps) - got.count() == want


def _clusters(fps):
    left, out = set(range(len(fps))), []
    while left:
        todo, done = [left.pop()], []
        while todo:
            i = todo.pop()
            done.append(i)
            hit = [j for j in left if int(fps[i] ^ fps[j]).bit_count() <= 4]
            left -= set(hit)
            todo += hit
        out.append(done)
    return out


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert components(edges).select("component").distinct().collect()[0][0] == 0


def hit_words(docs, items):
    """Brute force: {doc: (hit word positions, items)} of word lists."""
    out = {}
    for i, doc in docs.items():
        hit, found = set(), set()
        for k, item in items.items():
            n = min(13, len(item))
            windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else set()
            at = {p for j in range(len(doc) - n + 1) if tuple(doc[j : j + n]) in windows for p in range(j, j + n)}
            hit |= at
            found |= {k} if at else set()
        out[i] = (hit, sorted(found))
    return out


def repeating(seed):
    """Documents and items of few words, with k-grams again after 1 to 9 words, short items and items that are cut off."""
    r = random.Random(seed)
    docs, items = {}, {}
    few = [f"v{i}" for i in range(6)]
    for k in range(60):
        items[f"f{k}"] = [r.choice(few) for _ in range(r.randint(13, 30))]
        docs[k] = [r.choice(few) for _ in range(20)] + items[f"f{k}"][: r.randint(10, 30)] + [r.choice(few) for _ in range(20)]
    for gap in range(1, 10):
        for k in range(10):
            doc = [f"u{r.randrange(10**6)}" for _ in range(40)]
            for j in range(5):
                doc[8 + gap + j] = doc[8 + j]
            a = r.randint(5, 8 + gap)
            docs[1000 + 10 * gap + k] = doc
            items[f"g{gap}-{k}"] = ["x0", "x1", *doc[a : a + 13], "y0"]
    for n in range(1, 13):
        items[f"s{n}"] = [f"s{n}w{j}" for j in range(n)]
        docs[2000 + n] = ["a", *items[f"s{n}"], "b"]
        docs[3000 + n] = items[f"s{n}"][:-1] + ["c"]
    return docs, items


@pytest.mark.parametrize("sent", (decontamination.SENT_ROWS, 0))
def test_hits_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(decontamination, "SENT_ROWS", sent)
    docs, items = repeating(8)
    made = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in items.items()] + [("none", ""), ("null", None)], "item_id string, text string")
    got = {r["doc_id"]: ({p for s in r["spans"] for p in range(s["start"], s["end"])}, r["items"]) for r in decontamination.benchmark_hits(made, bench).collect()}
    assert got == hit_words(docs, items)


def _kneser_ney(texts):
    """A function (history, symbol) -> probability, straight from the definition, of texts as lists of symbols."""
    n, pads = quality.ORDER, [quality.PAD] * (quality.ORDER - 1)
    seen = [{} for _ in range(n + 1)]
    for t in texts:
        s = pads + t + [quality.END]
        for i in range(n - 1, len(s)):
            g = tuple(s[i - n + 1 : i + 1])
            seen[n][g] = seen[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        for g in seen[k + 1]:
            seen[k][g[1:]] = seen[k].get(g[1:], 0) + 1
    cuts = [None] + [quality.discounts([sum(c == j for c in seen[k].values()) for j in (1, 2, 3, 4)]) for k in range(1, n + 1)]
    follow = [{} for _ in range(n + 1)]
    for k in range(1, n + 1):
        for g, c in seen[k].items():
            follow[k].setdefault(g[:-1], []).append(c)

    def p(history, symbol, k):
        if k == 0:
            return 1 / 256
        h = history[len(history) - k + 1 :] if k > 1 else ()
        lower = p(history, symbol, k - 1)
        if h not in follow[k]:
            return lower
        c = seen[k].get((*h, symbol), 0)
        back = sum(cuts[k][min(x, 3)] for x in follow[k][h])
        return (max(c - cuts[k][min(c, 3)], 0) + back * lower) / sum(follow[k][h])

    return lambda history, symbol: p(history, symbol, n)


def test_perplexity_is_that_of_the_definition(spark):
    r = random.Random(4)
    syllables = ["ba", "do", "ki", "é", "nu ", "ra.", " ", "\n", "7", "42"]
    made = [(i, "".join(r.choice(syllables) for _ in range(r.randint(1, 40))), "xx" if i % 3 else "yy") for i in range(150)]
    docs = spark.createDataFrame([*made, (200, "zzz unseen ba", "xx"), (201, None, "xx"), (202, "", "yy"), (203, "ba do", "zz"), (203, "ba do", "zz")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in quality.trusted_ids(labels).where("held_out").collect()}
    symbols = lambda t: quality.symbol_table()[np.frombuffer(t.encode(), np.uint8)].tolist()
    models = {x: _kneser_ney([symbols(t) for i, t, lang in made if lang == x and i not in held]) for x in ("xx", "yy")}
    rows = docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("row_hash"), F.col("lang").alias("model"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    train = rows.where(~F.col("doc_id").isin([*held, 200, 201, 202, 203])).select("lang", "text")
    weights, shards = quality.model(train, 1 << 27)
    got = {r["doc_id"]: r for r in quality.scored(rows, weights, shards).collect()}
    for i, t, lang in [*made, (200, "zzz unseen ba", "xx")]:
        s = [quality.PAD] * (quality.ORDER - 1) + symbols(t) + [quality.END]
        want = sum(math.log(models[lang](tuple(s[j - quality.ORDER + 1 : j]), s[j])) for j in range(quality.ORDER - 1, len(s)))
        assert abs(got[i]["ll"] / quality.UNIT - want) < 0.004 * len(s)
        assert got[i]["n"] == len(s) - quality.ORDER + 1
    assert got[201]["n"] == got[202]["n"] == 0
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == 155 and all(r["keep"] for r in rows if r["doc_id"] > 200)


def test_perplexity_of_rows_in_no_fixed_order(spark):
    """Every reading of the input deals its rows differently; each row is scored all the same."""
    r = random.Random(6)
    made = [(i, i, "", "".join(r.choice(("ba", "do ", "ki")) for _ in range(r.randint(0, 60))), "xx") for i in range(200)]
    rows = spark.createDataFrame(made, "doc_id long, row_hash long, model string, text string, lang string")
    weights, shards = quality.model(rows.where("doc_id < 100").select(F.col("model").alias("lang"), "text"), 1 << 20)

    def dealt(frames):
        for pdf in frames:
            yield pdf.assign(place=np.random.default_rng().integers(0, 1000, len(pdf)))

    anew = rows.mapInPandas(dealt, rows._jdf.schema().toDDL() + ", place long").repartition(6, "place").drop("place")
    scores = lambda df: sorted(map(tuple, quality.scored(df, weights, shards).collect()))
    assert scores(anew) == scores(rows.coalesce(1)) and len(scores(anew)) == 200


def test_model_is_a_distribution():
    texts = [[97, 98, 97, 99, 97, 98], [98, 98, 97], [99, 97, 98, 97, 98]]
    p = _kneser_ney(texts)
    for h in ((2, 2, 2, 2), (97, 98, 97, 98), (1, 1, 97, 98), (5, 5, 5, 5)):
        assert abs(sum(p(h, s) for s in range(256)) - 1) < 1e-9


def test_fill_respects_limits_and_places_all():
    r = random.Random(2)
    sizes = [(t := r.randint(1, 100), 1, r.randint(0, t)) for _ in range(300)]
    made = packing.fill(sizes, (100, 8, 60)) if all(s[2] <= 60 for s in sizes) else packing.fill([(t, s, min(x, 60)) for t, s, x in sizes], (100, 8, 60))
    assert sorted(i for x in made for i in x) == list(range(300))
    assert all(sum(sizes[i][0] for i in x) <= 100 and len(x) <= 8 for x in made)


def test_instruction_examples(spark):
    import public_tokenizers

    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general remarks"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    rows = packing.pack_examples(turns, public_tokenizers.path("byte_bpe_50k.json"), (64, 4, 8)).collect()
    assert sum(r["loss"] > 0 for r in rows) == 1 and len(rows) == 3


def test_rendezvous_takes_the_best_score(spark):
    """The shard is the one of the least -ln(u) / weight, u from the hash of key and shard."""
    weights = [1.0, 0.5, 3.0]
    rows = spark.range(300).select(F.col("id").alias("k"), *[F.xxhash64("id", F.lit(i)).alias(f"h{i}") for i in range(3)])
    got = {r["k"]: r["shard"] for r in sharding.assigned(rows.select("k"), "k", weights).collect()}
    for r in rows.collect():
        scores = [-math.log((((r[f"h{i}"] & (2**64 - 1)) >> 11) + 0.5) / 2**53) / w for i, w in enumerate(weights)]
        assert got[r["k"]] == scores.index(min(scores))


def test_rendezvous_moves_rows_only_into_the_new_shard(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"))
    made = sharding.assigned(rows, "k", [1.0, 2.0, 1.0], 1.0).toPandas()
    assert set(made[made["shard"] != made.grown_shard].grown_shard) == {3}
    assert 0.45 < (made["shard"] == 1).mean() < 0.55


@pytest.mark.parametrize("sent", (urls.SENT, 0))
def test_mined_rules_on_held_out_pages(spark, monkeypatch, sent):
    """Bad are pages whose host has one word and whose path another; neither word alone tells. One label in fifty is wrong."""
    monkeypatch.setattr(urls, "SENT", sent)
    r, pages, truth = random.Random(11), [], {}
    for i in range(4000):
        host, path = r.choice(["casino", "news", "shop", "blog"]), r.choice(["win", "about", "list", "post"])
        truth[i] = (host, path) == ("casino", "win")
        pages.append((i, f"https://{host}-{r.randrange(40)}.example.org/{path}/{i}?ref={i % 7}"))
    pages += [(10_000 + i, "https://example.org/") for i in range(500)] + [(20_000, None)] * 3
    labels = spark.createDataFrame([(i, 1, int(truth[i] != (r.random() < 0.02))) for i in range(2000)], "doc_id long, quality int, toxic int")
    rows = urls.judged_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    got = {x["page_id"]: x["verdict"] == "block" for x in rows}
    assert len(rows) == len(pages)
    held = [i for i in range(2000, 4000)]
    hit = sum(got[i] and truth[i] for i in held)
    assert hit == sum(truth[i] for i in held) and hit / sum(got[i] for i in held) > 0.85
    assert not any(got[i] for i in got if i >= 10_000)


def test_mined_rules_block_what_labels_tell(spark):
    pages = [(i, f"https://{'spam-farm' if i % 10 == 0 else 'h' + str(i % 7)}.example.org/xx/{i}") for i in range(400)] + [(900, None), (901, "no host")]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judged_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert all((got[i] == "block") == (i % 10 == 0) for i in range(400)) and got[900] == got[901] == "allow"
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged_urls(nothing, labels).count() == 0


def test_base_spans_equal_plain_patterns():
    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice("a@.1-+ 9(%25") for _ in range(r.randint(0, 30)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[ -]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == want


def test_field_on_held_out_templates():
    field = pii.SemiMarkovField(pii.fitted())
    cases = pii.templates(100, 99)
    assert sum(field.find(t, *pii.region_of(t)) == true for t, true in cases) >= 95


def added(text):
    base = pii.base_spans(text)
    return [(k, text[a:b]) for k, a, b in pii.added_spans(text, base, pii.SemiMarkovField(pii.fitted()))]


def test_spaced_addresses_open_regions():
    for ip in ("10 . 2 . 33 . 4", "192 . 168 . 100 . 200", "10. 0. 0. 1"):
        for text in (ip, f"host {ip} is up"):
            assert added(text) == [("ip", ip)]


def test_long_regions_and_base_spans_hide_nothing():
    r = random.Random(12)
    d = lambda n: "".join(r.choice("23456789") for _ in range(n))
    phones = [f"({d(3)}) {d(3)}-{d(4)}" for _ in range(80)]
    assert added(" ".join(phones)) == [("phone", p) for p in phones]
    base = "10.20.30.40"
    assert pii.base_spans(f"{base} {phones[0]}") == [("ip", 0, 11)]
    assert added(f"{base} {phones[0]}") == added(f"{phones[0]} {base}") == [("phone", phones[0])]


def test_marginals_equal_enumeration():
    field = pii.SemiMarkovField({("phone", "f"): 0.7, ("ip", "g"): -0.2})
    into = [[], [(0, ["f"])], [(0, ["g"]), (1, ["f"])], [(1, ["f", "g"])]]
    segments = {0: []}
    paths = []

    def walk(at, score, used):
        if at == 3:
            paths.append((score, used))
            return
        walk(at + 1, score, used)
        for j in range(at + 1, 4):
            for i, f in into[j]:
                if i == at:
                    for k in pii.KINDS:
                        walk(j, score + field.score(k, f), [*used, (j, i, k)])

    walk(0, 0.0, segments[0])
    total, likely = field.marginals(into)
    assert math.isclose(total, math.log(sum(math.exp(s) for s, _ in paths)))
    for seg, p in likely.items():
        assert math.isclose(p, sum(math.exp(s) for s, u in paths if seg in u) / math.exp(total))


def test_guess_cost_is_the_cheapest_segmentation():
    for value in ("pass1999", "qweaaa1", "xK9!", "abcdroot"):
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=len(value) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(value)]
            pieces = [value[a:b] for a, b in itertools.pairwise(at)]
            best = min(best, sum(map(secrets.piece_cost, pieces)) + math.log10(math.factorial(len(pieces))))
        assert math.isclose(secrets.guess_cost(value), best)


def test_long_repeats_and_sequences_are_one_piece():
    assert secrets.guess_cost("a" * 24) < secrets.guess_cost("a" * 30) < secrets.guess_cost("a" * 3000) < 5
    assert secrets.guess_cost("xyz1" * 200) < 8 and secrets.guess_cost("abcdefghijklmnopqrstuvwxyz") < 4
    assert not secrets.costly("=" * 5000) and secrets.costly("=" * 500 + "xK9!qZ2&w7#") and secrets.costly("xK9!qZ2&w7#" + "=" * 500)


def test_costly_values_are_added_and_placeholders_are_not():
    text = 'pwd = "x7Kp!9zQ" password: changeme1 token = "aaaa"'
    assert [text[a:b] for _, a, b in secrets.added_spans(text, secrets.base_spans(text))] == ['pwd = "x7Kp!9zQ"']


def test_long_values_are_found_whole():
    secret = "p$9!" + "xK7#qZ2&" * 8 + "w%"
    for text in (f'password = "{secret}"', f"token: '{secret}'", f"pwd={secret}", f"pwd={''.join(random.Random(7).choices('abXY12!$', k=20_000))}"):
        assert secrets.added_spans(f"so {text} end", secrets.base_spans(f"so {text} end")) == [("assign", 3, 3 + len(text))]
    text = f"password = {secret}{'0123456789abcdef' * 2}"  # a fixed pattern in the value's end
    assert secrets.base_spans(text) and secrets.added_spans(text, secrets.base_spans(text)) == [("assign", 0, 11 + len(secret))]


def test_costly_prefixes_tell_as_whole_values_do():
    r = random.Random(4)
    for _ in range(150):
        value = "".join(r.choice(("a", "password", "1999", "qwe", "xK9", "-", "abcabc", "=" * 20)) for _ in range(r.randint(1, 6)))
        assert secrets.costly(value) == (secrets.guess_cost(value) >= secrets.COSTLY)


def test_marking_words_equal_plain_counts(spark):
    r = random.Random(5)
    plain = lambda n: [r.choice("alder birch cedar elm fir hazel larch maple oak pine".split()) for _ in range(n)]
    docs, labels = [], []
    for i in range(150):
        words, toxic = plain(r.randint(3, 40)), int(i % 3 == 0)
        if toxic and i % 2:
            words.insert(r.randint(0, len(words)), r.choice(["Zounds", "fie!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    family = "elm oak rareword pine"
    for i in range(150, 170):  # copies of one text do not make its words mark
        docs.append((i, family + "." * (i % 7)))
        labels.append((i, 1, 1))
    docs += [(200, "and FIE on it"), (201, "nothing here rareword"), (202, ""), (203, None), (None, "zounds"), (200, "and FIE on it")]
    rows = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    toxic, of = {i for i, _, x in labels if x}, dict(docs)
    cut = lambda t: re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    n_bad, n_good = len(toxic), len(labels) - len(toxic)
    want = set()
    for w in {w for t in of.values() for w in cut(t)} - {""}:
        bad = sum(w in cut(of[i]) for i in toxic)
        good = sum(w in cut(of[i]) for i, _, x in labels if not x)
        seen = {(([""] + ws)[k], (["", ""] + ws)[k]) for ws in (cut(of[i]) for i in toxic) for k, v in enumerate(ws) if v == w}
        least = max(quality.MARK_LEAST, quality.MARK_SHARE * n_bad)
        if bad >= least and len(seen) >= least and bad / n_bad >= quality.MARK_ODDS * (good + 0.5) / (n_good + 1):
            want.add(w)
    assert want == {"zounds", "fie"}
    got = {r["doc_id"]: (r["n_marking"], r["keep"]) for r in quality.judged(rows, table).collect()}
    assert all(got[i][0] == len(want & set(cut(t))) for i, t in docs)
    assert not any(keep for n, keep in got.values() if n) and got[202] == got[203] == (0, True)
    none = quality.judged(rows, table.where("toxic = 0")).where("n_marking > 0")
    assert none.count() == 0


def test_copies_and_rare_shares_do_not_hide_marking_words(spark):
    r = random.Random(6)
    text = lambda *more: " ".join(r.sample("alder birch cedar elm fir hazel larch maple oak pine".split(), 8) + [*more] + [f"n{r.randrange(10**6)}"])
    toxic = ["one text that is copied"] * 600 + [text("zounds") if i < 20 else text() for i in range(1300)]
    texts = [(t, 1) for t in toxic] + [(text(), 0) for _ in range(2600)] + [("zounds again", None), ("nothing here", None)]
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, x) for i, (_, x) in enumerate(texts) if x is not None], "doc_id long, quality int, toxic int")
    marks = {r["doc_id"]: r["n_marking"] for r in quality.judged(docs, labels).collect()}
    assert {i for i, n in marks.items() if n} == {i for i, (t, _) in enumerate(texts) if "zounds" in t.split()}


def test_ids_survive_packing_beside_nulls(spark):
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, "some words " * (3 + k)) for k, i in enumerate(ids)], "doc_id long, text string")
    made = packing.documents_packed(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in made))) == sorted(map(str, ids))
    assert sorted(r["offset"] for r in made)[0] == 0


def test_winnowing_keeps_about_two_in_ten():
    rng = np.random.default_rng(0)
    words, text = rng.integers(0, 2**63, 20_000).astype(np.uint64), np.repeat([0, 1], 10_000)
    at = decontamination.winnowed(decontamination.gram_hashes(words, decontamination.GRAM), text)
    assert abs(len(at) / len(words) - 2 / (decontamination.WINDOW + 1)) < 0.02
    gaps = np.diff(at[at < 9_000])
    assert gaps.max() <= decontamination.WINDOW  # every window has one
    assert decontamination.winnowed(words[:3], text[:3]).size == 0


def test_a_text_of_many_copies_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SENT_ROWS", 0)
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"x {item} y") for i in range(60)], "doc_id long, text string")
    rows = decontamination.contamination(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in rows} == {(20, 1, True)} and len(rows) == 60
    parts = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(7).cast("long")), F.lit(decontamination.SALTS))).distinct().count()
    assert parts > 1
