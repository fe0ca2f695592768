"""The corpus operators against brute force on small fixtures, with nulls, empty texts, ties and odd columns."""

import collections
import hashlib
import html as H
import math
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fitgrid.llm import class_lm, embedding_dedup, html_extraction, mixing, near_dedup, packing, quality, substring_dedup, toxicity, url_filter
from fitgrid.llm.queries import ORACLES, QUERIES
from fitgrid.llm.kernels import shingle_sets, windows

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row long, kept boolean"


def words(t, lower=False):
    b = (t or "").encode()
    return (b.translate(LOWER) if lower else b).split()


def odd_texts():
    base = " ".join(f"w{i % 97}x{i % 31}" for i in range(400))
    near = base.replace("w5x5", "other", 1)
    return [(0, base), (1, near), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "One TWO"), (8, "a b c d e f"), (9, "x" * 100_000), (10, " ".join(f"long{i}" for i in range(30_000))), (11, "para graph \x1c odd   spaces"), (12, base[:700] + " tail"), (None, base), (8, "a b c d e f"), (13, "<|endoftext|> and 中文 text"), (14, "the " * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), "clash", 1, True) for d, t in rows], SCHEMA)


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_windows_hash_only_the_words():
    h = np.arange(50, dtype=np.uint64)
    for k in (1, 2, 5, 9, 35):
        w = windows(h, k)
        assert len(w) == 51 - k and len(set(w.tolist())) == len(w)
        assert windows(h[7 : 7 + k], k)[0] == w[7]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = odd_texts()
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows), k, 80).collect()}
    sets = {}
    for d, t in rows:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = [d for d in sets if d is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, links)
    assert got == {(d, len(sets[d])): (want[d], want[d] == d) for d in ids} | {(None, len(sets[None])): (None, True)}


def test_stars_and_prefixes_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(150):  # a cloud of copies, of which many pairs are just under the threshold
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[at] = f"m{d}x{at}"
        rows.append((d, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), 4, 80).collect()}
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(117)} for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == components(list(sets), links)


def test_an_id_with_several_texts_links_by_each_of_them(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEETS", 3)  # stars are dealt to several tasks
    rng = np.random.default_rng(2)

    def text():
        return [f"w{int(x)}" for x in rng.integers(0, 10**9, 80)]

    rows = []
    for g in range(0, 2000, 100):
        a, b = text(), text()
        rows += [(g + 5, a), (g + 5, b), (g + 1, [*a[:-1], "end"]), (g + 2, [*b[:-1], "end"]), (g + 7, text()), (g + 9, a)]
        rows += [(g + 20 + i, [*a[:-2], f"x{i}", "y"]) for i in range(12)]
    got = near_dedup.near_duplicates(frame(spark, [(d, " ".join(t)) for d, t in rows]), 4, 80).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, d if d % 100 == 7 else d - d % 100 + 1) for d, _ in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def brute_repeats(rows, width):
    seen = collections.Counter(tuple(words(t)[i : i + width]) for _, t in rows for i in range(len(words(t)) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substring_dedup(spark):
    rows = odd_texts()
    got = [tuple(r) for r in substring_dedup.repeats_digest(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(rows, 35), key=repr)
    out = substring_dedup.remove_repeats(frame(spark, rows))
    assert out.columns == SCHEMA_COLUMNS and out.count() == len(rows)


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_quality_statistics(spark):
    rows = [(1, "a b c a b c\nline one\nline one\n\n#x ê*"), (2, None), (3, ""), (4, "solo"), (5, "x y z " * 40)]
    got = {r["doc_id"]: r for r in quality.quality_filter(frame(spark, rows)).collect()}
    r = got[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (12, 24, 2, 1, 6, True)
    assert (got[2]["n_words"], got[2]["kept"]) == (0, False) and got[5]["base_failed"] and got[5]["n_repeat_words"] == 120


def test_votes_give_the_planted_classes():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.8
    votes = np.where(truth[:, None], np.where(rng.random((5000, 4)) < 0.5, 1, 0), np.where(rng.random((5000, 4)) < 0.6, -1, 0))
    _, good = quality.fit_votes(votes, np.ones(5000))
    assert ((good >= 0.5) == truth).mean() > 0.95


def brute_quality(rows):
    """Posteriors text by text, from Python's own words and lines; no patterns, no arrays."""
    kinds = quality.KINDS
    votes = []
    for t in rows:
        w, text = words(t), t or ""
        lines, seen, dup = [x for x in text.split("\n") if x.split()], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = collections.Counter(three)
        again = {i + k for i, x in enumerate(three) if many[x] > 1 for k in range(3)}
        n = max(len(w), 1)
        mean, symbols, share, repeat = sum(len(x.decode()) for x in w) / n, sum(c in "#*$%&|<>" for c in text) / n, dup / max(len(lines), 1), len(again) / n
        letters = [c for c in text if c.isascii() and c.isalpha()]
        upper, shout, distinct = sum(c.isupper() for c in letters) / max(len(letters), 1), sum(x.endswith(b"!") for x in w) / n, len(set(w)) / n
        both = [(len(w) < 20, len(w) >= 100), (mean < 3.5 or mean > 7, 4 <= mean <= 6.5), (symbols > 0.1, symbols < 0.02), (share > 0.3, share < 0.1), (repeat > 0.4, repeat < 0.1), (upper > 0.5, upper < 0.2), (shout > 0.2, shout < 0.02), (distinct < 0.15 and len(w) < 2000, distinct > 0.35)]
        votes.append([-1 if bad else int(good) for bad, good in both])
    post = []
    for v in votes:
        fired = [kinds[r] for r, x in enumerate(v) if x == -1]
        post.append([0.1] + [0.9 * fired.count(k) / len(fired) for k in range(4)] if fired else [0.9] + [0.025] * 4)
    for _ in range(quality.ROUNDS):
        size = [sum(p[c] for p in post) for c in range(5)]
        cast = [[{x: (sum(p[c] for p, v in zip(post, votes) if v[r] == x) + 1) / (size[c] + 3) for x in (-1, 0, 1)} for c in range(5)] for r in range(8)]
        new = []
        for v in votes:
            like = [math.log((size[c] + 1) / (len(votes) + 5)) + sum(math.log(cast[r][c][x]) for r, x in enumerate(v)) for c in range(5)]
            odds = [math.exp(x - max(like)) for x in like]
            new.append([x / sum(odds) for x in odds])
        done = max(abs(a - b) for p, q in zip(post, new) for a, b in zip(p, q)) < 1e-9
        post = new
        if done:
            break
    good = min(range(5), key=lambda c: sum(cast[r][c][-1] for r in range(8)))
    return [p[good] for p in post]


def test_quality_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(d, t) for d, t in odd_texts() if d not in (9, 10, None)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r for r in quality.quality_filter(frame(spark, rows)).collect()}
    want = brute_quality([t for _, t in rows])
    assert all(got[i]["quality"] == pytest.approx(q, abs=1e-6) for i, q in enumerate(want))
    assert all(got[i]["kept"] == (q >= 0.5 and not got[i]["base_failed"]) for i, q in enumerate(want) if abs(q - 0.5) > 1e-6)


def test_quality_verdicts_are_not_any_bad_vote(spark):
    from fitgrid.llm.common import table

    sf = "/root/testdata/sf0.1"
    rows = quality.quality_filter(table(spark, sf, "documents")).join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left").collect()
    any_bad = [any(r["pattern"] // 3**k % 3 == 0 for k in range(8)) for r in rows]
    assert sum(b and r["quality"] >= 0.5 for b, r in zip(any_bad, rows)) > 100
    labelled = [(r["quality"] >= 0.5) == bool(r["label"]) for r in rows if r["label"] is not None]
    assert np.mean(labelled) > 0.98


def test_class_lm_base_and_gain(spark):
    rng = np.random.default_rng(2)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("aa", "bb", "cc")]
    rows = [(d, " ".join(rng.choice(tongues[d % 3], 80))) for d in range(200)] + [(900, None), (901, "")]
    rows += [(5, rows[5][1])]
    got = class_lm.class_lm_scores(frame(spark, rows)).collect()
    count, total = collections.Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            w = words(t, True)
            count.update([*w, None])
            total += len(w) + 1
    scale = total + 0.1 * (len(count) + 1)
    text = dict(rows)
    assert len(got) == len(rows)
    held = [0.0, 0.0]
    for r in got:
        tokens = [*words(text[r["doc_id"]], True), None]
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.1) / scale) for x in tokens))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(x in count for x in tokens), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


def test_class_lm_clusters_words_beyond_the_most_frequent(spark, monkeypatch):
    rng = np.random.default_rng(6)
    common = [[f"{p}{i}" for i in range(550)] for p in ("u", "v")]  # more than CORE words, each more often than the rare
    rare = [[f"{p}{i}end" for i in range(20)] for p in ("r", "s")]  # one bucket, two contexts
    rows = []
    for d in range(600):
        side = d % 2
        text = [str(x) for x in rng.choice(common[side], 200)]
        for at in range(0, 200, 10):
            text[at] = str(rng.choice(rare[side]))
        rows.append((d, " ".join(text)))
    seen, real = [], class_lm.own_classes
    monkeypatch.setattr(class_lm, "ROUNDS", 2)

    def spy(train, head, kind, own, often, of, n):
        seen.append((head, own, *real(train, head, kind, own, often, of, n), n))
        return seen[-1][2:4]

    monkeypatch.setattr(class_lm, "own_classes", spy)
    got = class_lm.class_lm_scores(frame(spark, rows))
    assert got.filter("score IS NULL OR isnan(score)").count() == 0
    head, own, kind, n, before = seen[0]
    at = {w: int(i) for side in (*common, *rare) for w in side for i in np.flatnonzero(head == _hash(w))}
    assert own.sum() == sum(len(w) for w in (*common, *rare)) - class_lm.CORE
    mids = [{w for w in (*c, *r) if own[at[w]]} for c, r in zip(common, rare, strict=True)]
    assert all(len(m) >= 20 for m in mids) and not {kind[at[w]] for w in mids[0]} & {kind[at[w]] for w in mids[1]}
    assert n.sum() == before.sum() == sum(201 for d, _ in rows if zlib.crc32(str(d).encode()) % 10)
    assert class_lm.likelihood(n) > class_lm.likelihood(before)
    # the second round is over all words, the most frequent included, and never lowers the likelihood that is used
    assert seen[1][1].sum() == own.sum() + class_lm.CORE and seen[1][4] is n


def test_best_class_has_the_greatest_likelihood():
    rng = np.random.default_rng(7)
    units, k = 12, 4
    pairs = rng.integers(0, 9, (units, units)).astype(float)
    of = np.append(rng.integers(0, k - 1, units - 1), k - 1)
    one = np.eye(k)[of]
    xlogx = class_lm._xlogx

    def likelihood(of):
        m = np.eye(k)[of].T @ pairs @ np.eye(k)[of]
        return xlogx(m).sum() - xlogx(m.sum(0)).sum() - xlogx(m.sum(1)).sum()

    to, come, own = pairs @ one, (one.T @ pairs).T, np.diagonal(pairs)
    own_class = one * own[:, None]
    got = class_lm.best_classes(one.T @ pairs @ one, to - own_class, come - own_class, own, of)
    for u in range(units - 1):
        by = [likelihood(np.where(np.arange(units) == u, c, of)) for c in range(k - 1)]
        assert by[got[u]] == pytest.approx(max(by))


def _hash(word):
    from fitgrid.llm.kernels import Words

    return Words(np.array([0, len(word)]), np.frombuffer(word.encode(), np.uint8), lower=True).hash[0]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.93
    odd = toxicity.scored(frame(spark, odd_texts()), toxicity.train(docs, labels)).collect()
    assert len(odd) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in odd)


def test_toxicity_without_labels(spark):
    model = toxicity.train(frame(spark, [(1, "x")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(frame(spark, [(1, "x"), (2, None)]), model).filter("score < 0.5").count() == 2


def test_urls(spark):
    rows = [(1, "https://Blog.Example.com/en/7?x=1"), (2, "http://a.com/en/9#t"), (3, "http://x.example.net/de/81"), (4, "nothing"), (5, None), (6, "ftp://b.org/es/"), (7, "http://notcom/en/1"), (8, "http://com?/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("f0", F.lit(1)).withColumn("suffix", F.lit("s"))
    model = url_filter.train_url_trees(spark.createDataFrame([], "url string, label int"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, model).collect()}
    assert got[1] == ("blog.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.com", "/en/9", "com/en/", "block")
    assert got[3] == ("x.example.net", "/de/81", "example.net/de/8", "block")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6][2:] == ("org/es/", "block") and got[7][2] is None and got[8][:2] == ("com", "")


def test_url_rules_are_the_contracts(spark):
    urls = {"com/en/": ("http://a.com/en/1", "block"), "example.com/en/7": ("http://example.com/en/7", "allow"), "net/de/": ("http://a.example.net/de/1", "allow"), "example.net/de/8": ("http://example.net/de/8", "block"), "org/es/": ("http://b.org/es/", "block")}
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls.values())], "page_id long, url string")
    # the model blocks nothing, then everything: a rule's own word stands either way
    for bias in (-9.0, 9.0):
        model = {"bias": bias, "trees": [], "suffixes": [], "prior": 0.5}
        got = {r["rule"]: r["verdict"] for r in url_filter.filter_urls(df, model).collect()}
        assert got == {rule: verdict for rule, (_, verdict) in urls.items()}


def test_url_trees_learn(spark):
    rows = [(f"http://site{i}.example.com/a/{i}", 0) for i in range(300)] + [(f"http://win-{i}-cash-{i}-now.example.org/{'9' * 30}?a={i}&b=1&c=2", 1) for i in range(300)]
    model = url_filter.train_url_trees(spark.createDataFrame(rows, "url string, label int"))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, model, rules=()).collect()}
    assert np.mean([(got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows)]) > 0.95


def cosine_links(rows, limit):
    ok = {i: (l, np.array(v, float)) for i, l, v in rows if i is not None and l is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    return [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.sqrt((ok[a][1] @ ok[a][1]) * (ok[b][1] @ ok[b][1])) >= limit]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, int(i % 2), [float(x) for x in centre[i % 6] + rng.normal(size=16) * 0.25]) for i in range(200)]
    rows += [(300, 0, rows[0][2]), (301, None, rows[0][2]), (302, 0, None), (303, 0, [0.0] * 16), (304, 0, [float("nan")] * 16), (305, 0, [None] * 16), (306, 0, []), (307, 0, [1.0, 2.0]), (None, 0, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("dim", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_duplicates(df, 0.93, tile=32).collect()}
    links = cosine_links(rows, 0.93)
    ids = [r[0] for r in rows if r[0] is not None]
    comp, n = components(ids, links), collections.Counter(x for p in links for x in p)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids} | {None: (0, None, True)}


def test_bands_lose_no_link():
    rng = np.random.default_rng(9)
    for limit in (0.5, 0.93, 0.999, 1.0):
        x = rng.normal(size=(400, 6))
        x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.05 * (1 - limit + 0.01), x])
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        axes = embedding_dedup.rotation(u)
        bands = np.floor(np.arccos(np.clip(u @ axes[:, :2], -1, 1)) / embedding_dedup.band_width(limit))
        i, j = np.nonzero(u @ u.T >= limit)
        assert len(i) > len(x) and (np.abs(bands[i] - bands[j]) <= 1).all()


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = odd_texts()
    got = packing.pack(frame(spark, rows)).toPandas()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((-1 if d is None else d, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    counts = collections.Counter(rng.integers(1, 2049, 20_000).tolist())
    runs = packing.plan(dict(counts))
    placed = collections.Counter()
    for lengths, times in runs:
        assert sum(lengths) <= 2048
        for x in lengths:
            placed[x] += times
    assert placed == counts
    assert sum(t for _, t in runs) <= 1.01 * sum(k * v for k, v in counts.items()) / 2048


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><header>Site name</header><nav><ul><li><a>Home</a></li></ul></nav><div class=\"cookie-notice\">We use cookies</div><main><article><h1>Title {i}</h1><p>First &amp; only {i}\n   words<br>here.<p>Second <b>bold</b> one.</p><aside>Side {i}</aside><form>Sign up</form></article></main><section id='comments'><p>Nice {i}</p></section><footer>&copy; me</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(5)] + [(8, None, None), (9, "u", ""), (10, "http://h.example/0", "plain text < 5 & more")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.extract_main_text(df).collect()}
    for i in range(5):
        text = f"Title {i}\nFirst & only {i} words here.\nSecond bold one."
        assert got[i] == (text, len(text))
    assert got[8] == ("", 0) and got[9] == ("", 0) and got[10][0] == "plain text < 5 & more"


def test_template_words_go_where_no_article_is_named():
    pages = [f"<body><div>Welcome to our daily site</div><div><p>{w}</p></div><div>Call us any time now</div></body>" for w in ("red fox runs", "blue sea waits long", "old tree stands", "new day breaks again")]
    assert html_extraction.extract(pages)[1] == "blue sea waits long"


def foreign_pages(n=12):
    """Pages whose classes say nothing: a bar of links, an advert and a footer that differ from page to page, and long rules that do not."""
    pages, texts, rules = [], [], " ".join(f"rule{k} says" for k in range(100))
    for i in range(n):
        body = [" ".join(f"w{i}x{k}x{j}" for j in range(10 + 7 * k)) for k in range(2 + i % 3)]
        links = "".join(f"<a href=/{j}>go{i}x{j}</a> " for j in range(5))
        shared = '<p class="share-price">The price of a share fell</p>' if i == 3 else ""
        pages.append(f"<body><div class=q1>{links}</div><div class=q2>buy thing{i} now or never</div><div class=q3><div class=q4><h1>Head {i}</h1></div><div class=q5><p>{'<p>'.join(body)}{shared}</div></div><div class=q6>page {i} of our site, made by us</div><div class=q7>{rules}</div></body>")
        texts.append("\n".join([f"Head {i}", *body] + (["The price of a share fell"] if shared else [])))
    return pages, texts


def test_classes_decide_where_names_say_nothing():
    pages, texts = foreign_pages()
    assert html_extraction.extract(pages) == texts
    roles = html_extraction.Roles()
    parsed = [html_extraction.parse(p, roles) for p in pages]
    template = html_extraction.Template(roles, parsed)
    assert all((r, "<" + n) in template.tokens for r, n in roles.name.items() if n == "div")
    # without the classes there are no slots: a page alone gives its longest part, which is template here
    assert html_extraction.extract(pages[:1])[0].startswith("rule0 says") and html_extraction.extract(pages[:3]) == texts[:3]


def test_without_classes_the_texts_are_others(spark, monkeypatch):
    blocks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/pages.parquet").orderBy("page_id").collect():
        blocks[r["url"].split("/")[2]].append(r["html"])
    blocks = [b for b in blocks.values() if len(set(b)) >= 3]
    got = [t for b in blocks for t in html_extraction.extract(b)]
    assert len(got) > 100
    with monkeypatch.context() as m:  # the names alone choose nothing
        m.setattr(html_extraction, "NAMES", frozenset())
        m.setattr(html_extraction, "OUTSIDE", frozenset())
        assert [t for b in blocks for t in html_extraction.extract(b)] == got
    monkeypatch.setattr(html_extraction, "classes", lambda *_: set())
    other = [t for b in blocks for t in html_extraction.extract(b)]
    assert sum(a != b for a, b in zip(got, other, strict=True)) > 0.9 * len(got)


def brute_extract(pages):
    """The text in the slot of most words, by plain loops: an element is a frame if its start tag, with the path above it, is
    of a class of three tokens or more (equal counts on every page); words of such classes are template."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.found = (), []

        def handle_starttag(self, tag, attrs):
            self.path += ((tag, *(v for _, v in attrs)),)
            self.found.append((self.path, "<", None))

        def handle_endtag(self, tag):
            self.found.append((self.path, ">", None))
            self.path = self.path[:-1]

        def handle_data(self, data):
            self.found += [(self.path, w, w) for w in data.split()]

    read = []
    for page in pages:
        reader = Reader()
        reader.feed(page)
        read.append(reader.found)
    vectors = collections.defaultdict(set)
    for token in {t[:2] for found in read for t in found}:
        vectors[tuple(sum(t[:2] == token for t in found) for found in read)].add(token)
    shared = {t for v, ts in vectors.items() for t in ts if min(v) > 0 and len(ts) >= 3}
    frames = {t[0] for t in shared if t[1] == "<"}

    def frame(path):
        while path and path not in frames:
            path = path[:-1]
        return path

    texts = []
    for found in read:
        words = collections.Counter(frame(path) for path, token, w in found if w and (path, token) not in shared and "a" not in {e[0] for e in path})
        best = max(words, key=words.get)
        while best[-1][0] in ("p", "b"):
            best = best[:-1]
        lines, last = [], None
        for path, token, w in found:
            if path[: len(best)] == best:
                if w and (path, token) not in shared:
                    if last is None:
                        lines.append([])
                    lines[-1].append(w)
                    last = path
                elif w is None and path[-1][0] in ("div", "p", "h1"):
                    last = None
        texts.append("\n".join(map(" ".join, lines)))
    return texts


def test_extraction_against_plain_loops():
    rng = np.random.default_rng(11)
    for host in range(6):
        pages, n = [], int(rng.integers(3, 9))
        for i in range(n):
            def own(k, i=i):
                return " ".join(f"h{host}p{i}w{int(w)}" for w in rng.integers(0, 10**6, k))

            links = "".join(f"<a>{own(2)}</a>" for _ in range(4))
            body = "".join(f"<p>{own(int(rng.integers(30, 60)))} <b>{own(2)}</b></p>" for _ in range(int(rng.integers(1, 4))))
            pages.append(f"<body><div class=q1>{links}</div><div class=q2>fixed words on all pages {own(1)}</div><div class=q3>{body}</div><div class=q4>{own(3)} made by us</div></body>")
        assert html_extraction.extract(pages) == brute_extract(pages)


def brute_classes(sequences, least):
    """Tokens once on a page with equal occurrences, in the order that most of them keep, by trying subsets."""
    import itertools

    vectors = collections.defaultdict(list)
    for k in {k for s in sequences for k in s}:
        vectors[tuple(s.count(k) for s in sequences)].append(k)
    best = {}
    for v, keys in vectors.items():
        if sum(map(bool, v)) < least or max(v) > 1:
            continue
        for size in range(len(keys), 2, -1):
            found = [set(c) for c in itertools.combinations(keys, size) if len({tuple(k for k in s if k in c) for s in sequences if any(k in c for k in s)}) == 1]
            if found:
                best[v] = found
                break
    return best


def test_classes_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(30):
        fixed = [(0, f"t{i}") for i in range(6)]
        sequences = []
        for p in range(7):
            own = [(0, f"p{p}x{i}") for i in range(4)] + [(0, "loose")]
            s = [*fixed, *own]
            for k in own:  # own words, and one that all pages have, lie anywhere
                s.remove(k)
                s.insert(int(rng.integers(0, len(s) + 1)), k)
            sequences.append(s)
        numbers = sorted({k for s in sequences for k in s})
        got = {numbers[i] for i in html_extraction.classes([np.array([numbers.index(k) for k in s]) for s in sequences], 3)}
        want = brute_classes(sequences, 3)
        assert any(got == w for w in want[(1,) * 7])


def test_malformed_and_long_pages_take_linear_time():
    import time

    for unit in ("<div x='", "<div x='>'", "<a \"'>", "<", "</x>", "<!--", "<script>", "<p>", "class ", "<b><div>"):
        began = time.perf_counter()
        assert isinstance(html_extraction.extract([unit * (1_000_000 // len(unit))])[0], str)
        assert time.perf_counter() - began < 10, unit
    deep = "<div>" * 50_000 + "deep text"
    assert html_extraction.extract([deep, deep, None, ""]) == ["deep text", "deep text", "", ""]
    long = "<article><p>" + "word " * 300_000 + "</article>"
    assert html_extraction.extract([long])[0].count("word") == 300_000


def test_pages_do_not_depend_on_partitions(spark):
    pages, texts = foreign_pages(150)
    rows = [(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)] + [(0, "http://one.example/0", pages[0])] * 300
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 7):
        got = [(r["page_id"], r["text"]) for r in html_extraction.extract_main_text(df.repartition(n)).collect()]
        assert sorted(got) == sorted((i, texts[i]) for i, *_ in rows)


def test_template_lines_go_inside_articles_and_copies_stay():
    def texts(articles):
        return html_extraction.extract([f"<body><div>Site</div><article>{a}</article></body>" for a in articles])

    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(12)]
    row = '<div class="tools">Share this story now</div><div class="by">Written by A{i} on day D{i}</div>'
    got = texts([f"<h1>Review {i}</h1>{row.replace('{i}', str(i))}<p>{b}</p>" for i, b in enumerate(body)])
    assert got == [f"Review {i}\nWritten by A{i} on day D{i}\n{b}" for i, b in enumerate(body)]
    # copies of one article, a passage on fewer pages than a template's, and few pages
    assert texts([f"<p>{body[0]}</p>"] * 12) == [body[0]] * 12
    shared = [f"<p>{b}</p>" + ("<p>One passage that many share</p>" if i < 8 else "") for i, b in enumerate(body)]
    assert texts(shared) == [s.replace("<p>", "").replace("</p>", "\n").strip() for s in shared]
    for n in range(1, 13):  # one rule for blocks of any size, none for those too small for classes
        few = [f"<p>{b}</p><p>Share this story now</p>" for b in body[:n]]
        assert texts(few) == [b if n >= 3 else f"{b}\nShare this story now" for b in body[:n]]


def test_mixing_budgets(spark):
    rows = [(d, " ".join(["w"] * 10)) for d in range(300)]
    df = spark.createDataFrame([(d, t, "big" if d >= 60 else f"s{d % 3}", "") for d, t in rows] + [(999, None, None, ""), (998, "", "big", "")], "doc_id long, text string, source string, lang string")
    out = mixing.mix(df, entropy=None, repeats=2.0, blocks=8).toPandas()
    tokens = out.groupby("source").__tokens.sum()
    assert set(out.doc_id) == set(range(300)) | {998, 999}
    assert tokens["big"] == 2400 and all(395 <= tokens[f"s{i}"] <= 400 for i in range(3))
    for (_, _), d in out.groupby(["source", "__pass"]):
        assert d.doc_id.is_unique


def test_mixing_draws_wordless_texts_in_every_pass_begun(spark):
    rows = [(d, " ".join(["w"] * 10), "a") for d in range(40)] + [(100 + d, "", "a") for d in range(40)]
    df = spark.createDataFrame([(d, t, s, "") for d, t, s in rows], "doc_id long, text string, source string, lang string")
    out = mixing.mix(df, entropy=None, repeats=None, budget=500.0).toPandas()
    for p, full in ((0, 40), (1, 10)):
        got = out[out["__pass"] == p]
        assert got.doc_id.is_unique and (got.doc_id < 100).sum() == full and (got.doc_id >= 100).sum() == 40


def test_exponent_meets_entropy(spark):
    s = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    t = mixing.exponent(s, entropy=0.8)
    p = np.array([0.9, 0.09, 0.01]) ** t
    p /= p.sum()
    assert -(p * np.log(p)).sum() / np.log(3) == pytest.approx(0.8, abs=1e-3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(docs).count() == 0
    assert substring_dedup.repeats_digest(docs).count() == 0
    assert quality.quality_filter(docs).count() == 0
    assert class_lm.class_lm_scores(docs).count() == 0
    assert packing.pack(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<double>")).count() == 0
    assert html_extraction.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, duck, name):
    from test_queries import assert_same

    assert_same(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_pipeline_against_plain_loops(spark):
    """Stage by stage, each on what the one before it kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    before = [tuple(r) for r in docs.collect()]
    kept = stages["toxicity"](spark, docs, DATA)
    low = {r["doc_id"] for r in toxicity.scored(docs, toxicity.train(docs, labels)).filter("score < 0.5").collect()}
    clean = [r for r in before if r[0] in low]
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(clean) and len(clean) < len(before)

    near = stages["minhash_near_dedup"](spark, kept, DATA)
    sets = {}
    for d, t, *_ in clean:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    heads = components(list(sets), links)
    alone = [r for r in clean if heads[r[0]] == r[0]]
    assert links and sorted(map(tuple, near.collect())) == sorted(alone)

    cut = stages["substring_dedup"](spark, near, DATA)
    want = {d: (n, gone, sha) for d, n, gone, sha in brute_repeats([(r[0], r[1]) for r in alone], 35)}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(got) == set(want) and any(gone for _, gone, _ in want.values())
    assert all(hashlib.sha256(b" ".join(words(got[d]))).hexdigest() == sha for d, (_, _, sha) in want.items())

    drawn = stages["mixing"](spark, cut, DATA)
    times = collections.Counter(r["doc_id"] for r in drawn.collect())
    assert set(times) == set(got) and set(times.values()) <= {1, 2}
    assert all(r["text"] == got[r["doc_id"]] for r in drawn.collect())

    from fitgrid.llm.packing import _encoder

    encode = _encoder("byte_bpe_50k.json", None)
    rows = stages["packing"](spark, drawn, DATA).collect()
    pieces, places = collections.defaultdict(int), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces == {d: n * (len(encode(got[d] or "")) + 1) for d, n in times.items()}
    for held in places.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(held)] == [0, *ends[:-1]]


def plain_toxicity(rows, rounds=120, penalty=1.0):
    """Log-count ratios and weights from (label, features), by loops over rows and features."""
    n1, n = sum(y for y, _ in rows), len(rows)
    pos, both = collections.Counter(), collections.Counter()
    for y, features in rows:
        both.update(features)
        if y:
            pos.update(features)
    ratio = {}
    for f, m in both.items():
        a, b = pos[f], m - pos[f]
        r = math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n - n1 + 2))
        if m >= 3 and abs(r) > 2.5 * math.sqrt(1 / (a + 1) + 1 / (b + 1)):
            ratio[f] = r
    w, bias, moved = dict.fromkeys(ratio, 0.0), math.log(n1 / (n - n1)), collections.defaultdict(lambda: [0.0, 0.0])
    for t in range(1, rounds + 1):
        g, g0 = {f: penalty * w[f] for f in w}, 0.0
        for y, features in rows:
            mine = [f for f in features if f in w]
            e = 1 / (1 + math.exp(-(bias + sum(w[f] * ratio[f] for f in mine)))) - y
            g0 += e
            for f in mine:
                g[f] += e * ratio[f]
        for f, x in [*g.items(), (None, g0)]:
            m = moved[f]
            m[0], m[1] = 0.9 * m[0] + 0.1 * x, 0.99 * m[1] + 0.01 * x * x
            step = 0.03 * (m[0] / (1 - 0.9**t)) / (math.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
            if f is None:
                bias -= step
            else:
                w[f] -= step
    return {f: w[f] * ratio[f] for f in w}, bias


def test_toxicity_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    good, bad = ["kind", "warm", "river", "stone", "walk"], ["foul", "rotten", "scum", "river", "stone"]
    texts = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good, 6)), int(i % 3 == 0)) for i in range(60)]
    docs, labels = frame(spark, [(i, t) for i, t, _ in texts]), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")

    def features(t):
        return {int(f) for _, part in toxicity._grams([t]) for f in part}

    weights, bias = plain_toxicity([(y, features(t)) for _, t, y in texts])
    model = toxicity.train(docs, labels)
    assert dict(zip(model[0].tolist(), model[1].tolist(), strict=True)) == pytest.approx(weights, abs=1e-6) and model[2] == pytest.approx(bias, abs=1e-6) and len(weights) > 20
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    for i, t, y in texts:
        score = 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in features(t)))))
        assert got[i] == pytest.approx(score, abs=1e-6) and (score >= 0.5) == bool(y)


def doubled(spark):
    """Odd rows, each twice, with columns whose names clash with those inside the operators."""
    extra = "__tokens long, score double, component long, bucket int, host string, lo long, pattern int, tile int"
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), "clash", 1, True, 7, 0.5, 1, 2, "h", 3, 4, 5) for d, t in odd_texts() * 2]
    return spark.createDataFrame(rows, SCHEMA + ", " + extra)


def test_toxicity_on_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    df = doubled(spark)
    got = collections.defaultdict(set)
    for r in toxicity.scored(df, model).collect():
        got[r["doc_id"]].add(r["score"])
    assert all(len(v) == 1 for d, v in got.items()) and toxicity.scored(df, model).count() == df.count()
    assert toxicity.scored(docs.limit(0), model).count() == 0
    kept = toxicity.drop_toxic(df, model)
    assert kept.schema == df.schema
    low = [r["doc_id"] for r in toxicity.scored(df, model).filter("score < 0.5").collect()]
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(low)


def test_toxic_rows_go_whatever_their_id(spark):
    model = (np.zeros(0, np.int32), np.zeros(0), 3.0)  # every text is toxic
    assert toxicity.drop_toxic(frame(spark, odd_texts()), model).count() == 0


def test_urls_on_odd_rows(spark):
    long = "http://a.example.org/" + "x/" * 50_000
    rows = [(1, long), (1, long), (2, "://"), (3, "://?"), (4, ""), (5, "HTTP://ÄB.COM/en/%F0?=&&=#"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "depth", "p")})
    model = url_filter.train_url_trees(spark.createDataFrame([("http://a.com/", 0), (long, 1), (None, 1)] * 30, "url string, label int"))
    got = url_filter.filter_urls(df, model).collect()
    assert len(got) == len(rows) and all(r["verdict"] in ("allow", "block") for r in got)
    by = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert by[2] == by[3] == by[4] == by[None] == ("", "") and by[1][0] == "a.example.org" and len(by[1][1]) == 100_001
    assert by[5] == ("Äb.com", "/en/%F0")
    assert url_filter.filter_urls(df.limit(0), model).count() == 0


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows(spark, rows):
    """Nulls, empty, long and repeated rows, ties and clashing names through every stage; and empty tables."""
    import corpus_pipeline

    docs = doubled(spark)
    docs = docs.limit(0) if rows == "none" else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n == 0 if rows == "none" else n > 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
    keys = packed.groupBy("doc_id", "piece", "ids_crc32", "copy").count().filter("count > 1")
    assert keys.count() == 0 and (rows == "none") == (packed.count() == 0)


def test_near_duplicates_stage_keeps_one_row_an_id_and_one_document_a_group(spark):
    import corpus_pipeline

    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.minhash_near_dedup(spark, frame(spark, odd_texts()), DATA).collect()]
    ids = [d for d, _ in out if d is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and not {1, 2} & set(ids) and (None, odd_texts()[0][1]) in out


def test_whole_mixture_is_brute_forced(spark):
    """Weights, passes and what is drawn, against plain sums over the same documents."""
    rows = [(d, " ".join(["w"] * (1 + d % 7)), "abc"[min(d // 40, 2)]) for d in range(100)]
    df = spark.createDataFrame([(d, t, s, "") for d, t, s in rows], "doc_id long, text string, source string, lang string")
    out = mixing.mix(df, entropy=0.99, repeats=None).toPandas()
    tokens = collections.Counter()
    for d, t, s in rows:
        tokens[s] += 1 + d % 7
    share = np.array([tokens[s] / sum(tokens.values()) for s in "abc"])

    def entropy(t):
        p = share**t / (share**t).sum()
        return -(p * np.log(p)).sum() / np.log(3)

    lo, hi = 0.0, 1.0  # entropy falls with the exponent: the greatest that still reaches the goal
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= 0.99 else (lo, mid)
    weight = dict(zip("abc", share**lo / (share**lo).sum()))
    passes = {s: weight[s] / tokens[s] for s in "abc"}
    passes = {s: p / min(passes.values()) for s, p in passes.items()}
    for s in "abc":
        own = out[out.source == s]
        assert own.__weight.iloc[0] == pytest.approx(weight[s], abs=1e-6)
        assert set(own.doc_id) == {d for d, _, x in rows if x == s}
        assert abs(own.__tokens.sum() - passes[s] * tokens[s]) <= 7
        assert own.groupby("doc_id").size().max() == math.ceil(passes[s] - 1e-6)
    assert entropy(mixing.exponent(spark.createDataFrame([(s, n) for s, n in tokens.items()], "source string, tokens long"), entropy=0.99)) >= 0.99
