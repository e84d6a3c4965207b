"""The text operators against brute force, and on nulls, empty and long texts, ties and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from geoframe.llm import classifier, components, langid, linededup, mixing, quality, simhash, tokencount, topk, urls
from geoframe.llm import sentencepiece as sp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    random.seed(seed)
    words = "the of and haus über été niño 日本 a,b x*** !! end.".split()
    lines = [" ".join(random.choice(words) for _ in range(random.randint(1, 30))) for _ in range(25)]
    rows = [(k, "\n".join(random.choice(lines) for _ in range(random.randint(1, 8))), random.choice(["en", "de", None]), random.choice(["a", "b", "é", None]), 1) for k in range(n)]
    odd = [None, "", " \n\t ", "word", "\n\n", "x " * 5000, "a" * 20000, "▁ ▁▁  b\x00", "A\u00a0b\u3000c"]
    rows += [(n + k, t, None, "a", None) for k, t in enumerate(odd)]
    return rows + [rows[0], rows[0], (None, rows[1][1], "en", None, 2), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    book = quality.ledger(docs.withColumn("n_words", F.lit("clash")).withColumn("t", F.col("text"))).collect()
    assert len(book) == docs.count() and quality.ledger(empty).count() == 0
    for r in book:
        w = WORD.findall(r.t or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        used = [x for x in (r.t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(used) - len(set(used)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.t or "")
    led = quality.ledger(docs)
    kept = quality.apply_policy(led, "v2").filter("kept").count()
    ablated = {r.rule: r for r in quality.ablate(led, "v2").collect()}
    assert set(ablated) == set(quality.POLICIES["v2"]) and all(r.kept_without - r.rejected_alone == kept for r in ablated.values())


def test_own_rules_and_ablation(spark):
    own = (quality.Rule("short", 3, "n_words < 3"), quality.Rule("symbols", 0, "n_symbols > 1"), quality.Rule("lines", 5, "n_lines > 1"))
    texts = ["one two three", "a ##", "x", None, "a b c ##", "a\nb\nc d", "#\n#"]
    book = quality.ledger(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), rules=own)
    fails = [{n for n, bad in (("short", len(w) < 3), ("symbols", (t or "").count("#") > 1), ("lines", "\n" in (t or ""))) if bad} for t in texts for w in [WORD.findall(t or "")]]
    got = {r.doc_id: r.failures for r in book.collect()}
    assert got == {k: sum(1 << r.bit for r in own if r.name in f) for k, f in enumerate(fails)}
    policy = ("short", "symbols")
    kept = {r.doc_id: r.ok for r in quality.apply_policy(book, policy, "ok", own).collect()}
    assert kept == {k: not f & set(policy) for k, f in enumerate(fails)}
    for r in quality.ablate(book, policy, own).collect():
        cut = [f & set(policy) for f in fails]
        assert (r.rejected, r.rejected_alone, r.kept_without) == (sum(r.rule in f for f in cut), sum(f == {r.rule} for f in cut), sum(not f - {r.rule} for f in cut))
    with pytest.raises(KeyError):
        quality.mask(("unknown",), own)


def test_language_id(docs, empty, spark):
    en, de = "the cat and the dog of the house " * 3, "der hund und die katze über das haus " * 3
    train = spark.createDataFrame([(k, (en, de)[k % 2], ("en", "de")[k % 2], None, None) for k in range(20)], SCHEMA)
    profiles = langid.train(train)
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(1, "the house and the cat", None, None, None), (2, "das haus und der hund", None, None, None), (3, None, None, None, None), (4, "12 !! 7", None, None, None), (5, "", None, None, None)], SCHEMA), profiles).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["en", "de", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, langid.train(empty)).filter("lang_pred <> 'und'").count() == 0 and langid.predict(docs, profiles).count() == docs.count() and langid.predict(empty, profiles).count() == 0
    counts = {(r.lang, r.code): r["rank"] for r in profiles.collect()}
    plain = collections.Counter(langid.grams(en, langid.letter_table()).tolist())
    order = [c for c, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))][: langid.TOP]
    assert [counts[("en", c)] for c in order] == list(range(len(order)))


def test_plain_language_id(docs):
    """Profiles, distances and scores by counting n-grams of words."""

    def grams(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        for w in low.split():
            w = f" {w} "
            yield from w[1:-1]
            yield from (w[k : k + 2] for k in range(len(w) - 1))
            yield from (w[k : k + 3] for k in range(len(w) - 2))

    def in_order(counts, top):  # ties by the code of the n-gram
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:top]

    rows = docs.collect()
    profiles = {}
    for lang in sorted({r.lang for r in rows} - {None}):
        counts = collections.Counter(g for r in rows if r.lang == lang for g in grams(r.text or ""))
        profiles[lang] = {g: k for k, g in enumerate(in_order(counts, 60))}
    worst = max(len(p) for p in profiles.values())
    made = langid.predict(docs.withColumn("t", F.col("text")), langid.train(docs, top=60), top_doc=40)
    for r in made.collect():
        own = in_order(collections.Counter(grams(r.t or "")), 40)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        off = {lang: sum(min(worst, abs(p[g] - k)) if g in p else worst for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(off, key=lambda x: (off[x], x))
        assert r.lang_pred == best and r.score == pytest.approx(1 - off[best] / (worst * len(own)))


def test_sentencepiece(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    for r in sp.digests(docs.withColumn("t", F.col("text"))).collect():
        ids = library.encode(r.t or "")
        spans = np.array([(p.begin, p.end) for p in library.encode(r.t or "", return_type="proto").pieces], "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sp.sha(",".join(map(str, ids)).encode()), sp.sha(library.decode(ids).encode()))
        assert r.spans_sha256 == sp.sha(spans.tobytes())
    rows = sp.encode(docs.withColumn("t", F.col("text")))
    for r in rows.collect():
        pieces = library.encode(r.t or "", return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in r.pieces] == [(p.id, p.begin, p.end) for p in pieces]
    back = sp.decode(rows.withColumn("ids", F.transform("pieces", lambda p: p["id"]))).filter("decoded <> replace(coalesce(t, ''), '▁', ' ')").count()
    assert back == 0 and sp.digests(empty).count() == 0


def test_sentencepiece_chunks_end_before_signs():
    model, library = sp.Model(sp.read_model()), sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    assert model.chunk.findall("▁thth,▁der.▁▁x%%%\n") == ["▁thth", ",", "▁der", ".", "▁▁x", "%%%", "\n"]
    letters = "a t e n x é ß ñ 中 😀 \u0301 ▁ \n \t . , ; ' \" ( ) [ ] - _ / % * # & 1 9 ² … ” ’ » — –".split(" ") + [" ", "  ", "the", "ing", "...", "--"]
    random.seed(7)
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randint(1, 40)))
        assert model.encode(text.encode()) == library.encode(text)
        ids, _, decoded, _ = model.digest(text.encode())
        assert ids == len(library.encode(text)) and decoded == sp.sha(library.decode(library.encode(text)).encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normalisation_offsets(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    model = sp.Model(sp.read_model())
    model.map, model.squeeze = sp.CharacterMap(proto.normalizer_spec.precompiled_charsmap), True
    for text in ["ＡＢＣ ﬁ  x ", "①②  ㌔", "Åé", "  ", "plain text"]:
        want, offsets = library.normalize(text, with_offsets=True)
        got, where = model.normalise(text.encode())
        starts, k = [], 0
        for c in got:
            starts.append(where[k])
            k += len(c.encode())
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        assert got == want and (not got or [*starts, where[k]] == [at[o] for o in offsets])


def test_token_counts(docs, empty):
    from tokenizers import models

    starts, parts = tokencount.vocabulary()
    automaton = tokencount.Automaton(starts, parts)
    library = models.WordPiece({x: i for i, x in enumerate(sorted(starts | parts | {"[UNK]"}))}, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=10**6)
    count = lambda w: len(library.tokenize(tokencount.MARK + w))
    random.seed(2)
    for w in {"".join(random.choice("abetinxz日😀é") for _ in range(random.randint(1, 12))) for _ in range(2000)}:
        assert (automaton.count(tokencount.MARK + w) or 1) == count(w), w
    for r in tokencount.token_counts(docs.withColumn("t", F.col("text")), starts, parts).collect():
        w = WORD.findall(r.t or "")
        assert r.n_words == len(w) and r.n_tokens == sum(greedy(tokencount.MARK + x, starts, parts) or 1 for x in w)
    for word in ("a" * 20000, "internationalization" * 400, "ab" * 3000 + "\x01"):
        assert automaton.count(tokencount.MARK + word) == greedy(tokencount.MARK + word, starts, parts)
    assert tokencount.token_counts(empty, starts, parts).count() == 0


def greedy(word, starts, parts):
    """Number of pieces by trying every length from the longest down; 0 where none fits."""
    at, n, pool, most = 0, 0, starts, max(map(len, starts | parts))
    while at < len(word):
        size = next((k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return 0
        at, n, pool = at + size, n + 1, parts
    return n


@pytest.mark.parametrize("seed", range(3))
def test_small_vocabularies(seed):
    random.seed(seed)
    for _ in range(200):
        make = lambda n: {"".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(n)}
        starts, parts = make(random.randint(1, 6)), make(random.randint(1, 6))
        automaton = tokencount.Automaton(starts, parts)
        for _ in range(20):
            word = "".join(random.choice("abc") for _ in range(random.randint(1, 9)))
            assert automaton.count(word) == greedy(word, starts, parts), (starts, parts, word)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(300 + k, [0.25] * 8) for k in range(120)]
    rows += [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (None, [1.0] * 8), (7, [0.5] * 8), (10, [0.5] * 8), (10, [0.5] * 8), (903, [1.0, 2.0]), (904, [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "own long, vec_id long, e array<float>").select("own", "vec_id", topk.quantised(F.col("e")).alias("weights"), F.lit(1).alias("rank"), F.lit(1).alias("ROWS"), F.lit(1).alias("a.b"))
    asked = df.filter("vec_id % 10 = 0")
    got = collections.Counter()
    for r in topk.top_k(df, asked, 5, own_col="own", shard=64).collect():
        got[(r.query_id, r["rank"], r.vec_id, r.score)] += 1
    good = [(r.own, r.vec_id, r.weights) for r in df.collect() if r.vec_id is not None and r.weights is not None]
    want = collections.Counter()
    for own, q, w in good:
        if q % 10 == 0:
            best = sorted((-sum(int(a) * int(b) for a, b in zip(w, v)), i) for o, i, v in good if o != own)[:5]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert got == want and len({q for q, *_ in got}) == 42
    assert topk.top_k(df, asked, 1).filter("query_id = vec_id").count() > 0  # without keys a row meets itself
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [3e4, 3e4]), (4, [2e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select(F.col("vec_id"), F.col("vec_id").alias("own"), topk.quantised(F.col("e")).alias("weights"))
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, df, own_col="own").collect()}
    whole = {r.vec_id: [int(x) for x in r.weights] for r in df.collect()}
    assert got == {(a, b): max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(whole[a], whole[b])))) for a in whole for b in whole if a != b}


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    docs = np.concatenate([rng.integers(-10, 10, (2000, 8)), rng.integers(500, 900, (100, 8))])
    q, ids = np.full((1, 8), 3.0), np.arange(2100)
    scores, _, seen = topk.search_shard(np.array([-1]), q, ids, ids, docs.astype(float), 10, 100)
    assert seen < 500
    _, found, seen = topk.search_shard(np.array([-1]), q, ids[:2000], ids[:2000], docs[:2000].astype(float), 10, 100, floor=scores[:, -1])
    assert not seen and (found == topk.HIGH).all()  # no block reaches the score to beat


def test_mixing(docs, empty):
    out, report = mixing.mix(docs, F.array("source"))
    rows = out.collect()
    assert len(rows) == docs.count() and sum(r["size"] for r in rows) == pytest.approx(sum(x["target"] for x in report))
    assert all(r.taken <= 3 * r["size"] for r in rows) and {x["source"] for x in report} == {"a", "b", "é", None} and report[-1]["source"] is None
    for x in report:
        took = sum(r.taken for r in rows if r.source == x["source"])
        assert abs(took - x["target"]) <= max([r["size"] for r in rows if r.source == x["source"]], default=0) * 3
    again, _ = mixing.mix(docs.repartition(7), F.array("source"))
    assert sorted(map(str, again.select("doc_id", "taken").collect())) == sorted(map(str, out.select("doc_id", "taken").collect()))
    assert mixing.mix(empty, F.array("source"))[0].count() == 0
    chosen = mixing.apply_mix(docs, F.array("source"))
    assert chosen.columns == docs.columns and chosen.count() == sum(r.taken // r["size"] for r in rows if r["size"])


def test_overlapping_sources(spark):
    random.seed(4)
    names = ["a", "b", "p\x1fq", None, "-"]
    rows = [(k, "w " * random.randint(1, 9), random.sample(names, random.randint(0, 3))) for k in range(400)] + [(400, None, ["a"]), (401, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    out, report = mixing.mix(docs, F.col("held"))
    taken = {r.doc_id: (r["size"], r.taken) for r in out.collect()}
    assert [x["source"] for x in report] == sorted((n for n in names if n is not None), key=str.encode) + [None]
    assert all(t % s == 0 and t <= 3 * s if s else t == 0 for s, t in taken.values()) and all(taken[k][1] == 0 for k, _, h in rows if not h)
    by = collections.defaultdict(list)
    for k, _, held in rows:
        by[frozenset(held or ())].append(taken[k])
    for x in report:  # sizes count every holder; the words of all quotas are there once
        assert x["size"] == sum(s for held, own in by.items() if x["source"] in held for s, _ in own)
    assert sum(x["target"] for x in report) <= sum(s for held, own in by.items() if held for s, _ in own) + 1e-6
    flow = mixing.min_cost_flow([(sum(s for s, _ in own), [[r["source"] for r in report].index(n) for n in held]) for held, own in by.items()], [int(x["target"] + 0.5) for x in report])
    assert sum(x["taken"] for x in report) == sum(sum(f.values()) for f in flow)
    assert abs(sum(t for _, t in taken.values()) - sum(x["taken"] for x in report)) <= 9 * len(by)


def test_water_fill_and_flow():
    assert mixing.water_fill([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    t = mixing.water_fill([1, 100, 100], [1, 1, 1])
    assert t[0] == 3 and t[1] == t[2] == 99
    flow = mixing.min_cost_flow([(10, [0, 1]), (10, [1])], [15, 15])
    assert sum(sum(f.values()) for f in flow) == 30 and flow[0].get(0) == 15 and sum(f.get(1, 0) for f in flow) == 15
    random.seed(3)
    for _ in range(20):  # against every whole-number routing of a small case
        caps = [(random.randint(1, 3), sorted(random.sample(range(2), random.randint(1, 2)))) for _ in range(2)]
        quotas = [random.randint(0, 4), random.randint(0, 4)]
        best = None
        for a in range(10):
            for b in range(10):
                for c in range(10):
                    for d in range(10):
                        x = [[a, b], [c, d]]
                        if any(x[p][s] and s not in caps[p][1] for p in range(2) for s in range(2)) or any(sum(x[p]) > 3 * caps[p][0] for p in range(2)) or any(x[0][s] + x[1][s] > quotas[s] for s in range(2)):
                            continue
                        cost = sum(max(0, sum(x[p]) - caps[p][0]) + 2 * max(0, sum(x[p]) - 2 * caps[p][0]) for p in range(2))
                        best = min(best or (1, 0), (-(a + b + c + d), cost))
        f = mixing.min_cost_flow(caps, quotas)
        cost = sum(max(0, sum(x.values()) - c) + 2 * max(0, sum(x.values()) - 2 * c) for x, (c, _) in zip(f, caps))
        assert (-sum(sum(x.values()) for x in f), cost) == best


def test_urls(spark):
    given = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q#f", "https://a.example.com/en/6", "ftp://net/de/1", "http://example.net/de/81", "http://x.example.net/de/7", "http://notorg/es/", "http://org/es/", "http://a://b/c", "http://h?x/y", "HTTP://Ä.ORG/es/1", "http://x\x00\x01\x00/\x00?q\n#\n", "://", "a://b\nc/en/7"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(given)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.judge(df, [(("q:q", "s:http"), 1.0)]).collect()}
    for k, u in enumerate(given):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r.host + r.path), r.host + r.path, r.verdict) for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits)[1] if fits else None
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and got[k].verdict == (max(fits)[2] if fits else "allow")
    assert urls.judge(df.limit(0), []).count() == 0


def test_mined_rules(spark):
    rows = [(["h:spam", "h:com"], 1)] * 30 + [(["h:good", "h:com"], 0)] * 60 + [(["h:few"], 1)] * 3 + [(None, 1), (["h:good"], None)]
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label int"))
    assert rules == [(("h:spam",), 1.0)] and urls.mine(spark.createDataFrame([], "tokens array<string>, label int")) == []
    pages = spark.createDataFrame([(1, "http://spam.com/"), (2, "http://good.com/")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.mined) for r in urls.judge(pages, rules, ()).collect()} == {1: ("block", ["h:spam"]), 2: ("allow", None)}


def test_whole_url_filter(spark):
    """Labels, mined sets, pruning and verdicts against every set of tokens of every labelled URL."""
    random.seed(6)
    given = [f"http{random.choice(['', 's'])}://{random.choice(['', 'm.'])}{random.choice(['bets', 'news', 'shop'])}.example.{random.choice(['com', 'net', 'org'])}/{random.choice(['en', 'de', 'es', 'fr'])}/{random.choice(['7', '8', '91'])}{random.choice(['', '/casino/win.html', '?ref=x', '#top'])}" for _ in range(700)]
    given += [None, "", "no url", "http://org/es/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, urls.mine(urls.label_urls(pages))).collect()}
    ruled = {k: r for k, r in got.items() if r.rule is not None}
    sets = collections.defaultdict(lambda: [0, 0])
    for k, r in ruled.items():
        own = urls.tokens(given[k])
        for m in range(1, 1 << len(own)):
            sets[frozenset(t for i, t in enumerate(own) if m >> i & 1)][r.verdict == "block"] += 1
    least = max(20, 0.01 * len(ruled))
    sure = {x: b / (a + b) for x, (a, b) in sets.items() if b >= least and b / (a + b) >= 0.95}
    minimal = {x: c for x, c in sure.items() if not any(y < x and d >= c for y, d in sure.items())}
    assert minimal
    for k, r in got.items():
        if k not in ruled:
            own = set(urls.tokens(given[k] or ""))
            hits = sorted((-c, len(x), tuple(sorted(x))) for x, c in minimal.items() if x <= own)
            assert (r.verdict, r.mined) == (("block", list(hits[0][2])) if hits else ("allow", None))
    assert sum(r.mined is not None for r in got.values()) > 10


def test_tokens_of_a_url():
    assert urls.tokens("HTTP://A.b/x/Y-1.html?K=v&z#F") == ["f:f", "h:a", "h:b", "p:1", "p:html", "p:x", "p:y", "q:k", "q:k=v", "q:z", "s:http"]
    assert urls.tokens("") == urls.tokens("a/b") == [] and urls.tokens("://") == ["s:"]


def plain_removed(rows, min_words):
    """Lines that go, by the longest earlier match of every place."""
    rows = sorted({(k if k is not None else 1 << 62, t) for k, t in rows}, key=lambda x: x[0])
    seen, out = collections.defaultdict(list), {}
    texts = [[(n, x.strip(" \t\n\r\x0b\x0c"), len(WORD.findall(x))) for n, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t in rows]
    for d, own in enumerate(texts):
        gone = set()
        for p in range(len(own)):
            for e, q in seen[own[p][1]]:
                n = 0
                while p + n < len(own) and q + n < len(texts[e]) and own[p + n][1] == texts[e][q + n][1]:
                    n += 1
                if sum(x[2] for x in own[p : p + n]) >= min_words:
                    gone |= set(range(own[p][0], own[p + n - 1][0] + 1))
            seen[own[p][1]].append((d, p))
        out[rows[d]] = len(gone)
    return out


def test_line_dedup(docs, empty):
    for min_words in (5, 25):
        base = docs.filter("doc_id IS NOT NULL")
        want = plain_removed([(r.doc_id, r.text) for r in base.collect()], min_words)
        made = linededup.remove_repeated_lines(base.withColumn("t", F.col("text")).withColumn("n_lines", F.lit("clash")), min_words=min_words).collect()
        assert len(made) == base.count() and sum(want.values()) > 0
        for r in made:
            assert r.n_removed == want[(r.doc_id, r.t)]
            assert (r.text or "").count("\n") + 1 in ((r.t or "").count("\n") + 1 - r.n_removed, 1)
    assert linededup.remove_repeated_lines(docs).count() == docs.count() and linededup.remove_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("seed", range(1))
def test_long_runs(spark, seed):
    """Runs far longer than the threshold, runs of one line, copies of whole texts, over few distinct lines."""
    random.seed(seed)
    some = [f"w{k} " * random.randint(1, 3) for k in range(3)]
    block = [random.choice(some) for _ in range(40)]
    rows = []
    for d in range(30):
        own = [random.choice(some) for _ in range(random.randint(0, 6))]
        if random.random() < 0.6:
            at = random.randint(0, 30)
            own += block[at : at + random.randint(1, 40)]
        if random.random() < 0.2:
            own += [some[0]] * random.randint(1, 30)
        if random.random() < 0.5:
            own.insert(random.randint(0, len(own)), f"once{d}")
        rows.append((d, "\n".join(own)))
    rows += [(30, rows[4][1]), (31, rows[4][1])]
    want = plain_removed(rows, 9)
    made = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=9)
    assert {r.doc_id: r.n_removed for r in made.collect()} == {k: n for (k, _), n in want.items()} and sum(want.values()) > 100


@pytest.mark.parametrize("seed", range(3))
def test_intervals_by_slices(spark, seed):
    """A suffix array cut into slices gives each suffix the longest run with an earlier place."""
    random.seed(seed)
    text = [random.choice("ab") for _ in range(150)] + ["b"] * 40
    order = sorted(range(len(text)), key=lambda k: text[k:])

    def common(i, j):
        n = 0
        while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n

    rows = [(r, k, 0, 1, common(order[r - 1], k) if r else 0) for r, k in enumerate(order)]
    got = {r.pos: r.depth for r in linededup.repeated_before(spark.createDataFrame(rows, "rank long, pos long, d long, n int, lcp long"), ends=seed * 40 + 30).collect()}
    assert got == {k: max([common(k, j) for j in range(k)], default=0) for k in range(len(text))}


def test_trie_join():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62, 6).astype(np.uint64)
    keys = {int(c) for c in centre}
    for _ in range(400):
        k = int(rng.choice(centre))
        for b in rng.integers(0, 48, rng.integers(1, 6)):
            k ^= 1 << int(b)
        keys.add(k)
    own = np.array(sorted(keys), np.uint64)
    group = (own >> np.uint64(48)).astype(np.int64)
    got = [(int(a), int(b)) for i, j in simhash.trie_join(own, group, 48, 3) for a, b in zip(i, j)]
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if group[i] == group[j] and (int(own[i]) ^ int(own[j])).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("hot", [simhash.HOT, 7])
def test_links_and_components(spark, hot):
    random.seed(hot)
    keys = {0}
    for _ in range(12):
        c = random.getrandbits(64)
        for _ in range(25):
            k = c
            for _ in range(random.randint(0, 5)):
                k ^= 1 << random.randrange(64)
            keys.add(k)
    own = sorted(keys)
    root = {k: k for k in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(simhash.signed(k),) for k in own], "fp long")
    got = {r.key & (1 << 64) - 1: r.root for r in components.components(simhash.links(df, hot=hot)).collect()}
    groups = lambda f: {frozenset(x) for x in _groups(own, f)}
    assert groups(find) == groups(lambda k: got.get(k, simhash.signed(k)))


def _groups(items, f):
    by = collections.defaultdict(set)
    for x in items:
        by[f(x)].add(x)
    return by.values()


def test_near_duplicates(docs, empty):
    def plain(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [r.text for r in docs.collect()]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [plain(t) for t in texts]
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and simhash.near_duplicates(empty).count() == 0
    by = _groups([(r.doc_id, r.fp, r.component_id) for r in rows], lambda x: x[2])
    assert all(min(i for i, _, _ in g if i is not None) == next(iter(g))[2] for g in by)
    root = {t: t for t in {r.fp for r in rows}}
    for a in sorted(root):  # components by all pairs
        for b in sorted(root):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[root[r.fp]] = min(least.get(root[r.fp], r.doc_id), r.doc_id)
    assert all(r.component_id == least[root[r.fp]] for r in rows)


def test_classifier(docs, empty, spark):
    good, bad = "the quiet house stands by the river and waits", "buy$$$ now!! cheap*** pills%%% buy$$$ now!!"
    train = spark.createDataFrame([(k, (bad, good)[k % 2] + f" {k}", None, None, None) for k in range(200)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    weights = classifier.fit(train, labels, max_rows=100)
    got = {r.doc_id: r.score for r in classifier.score(spark.createDataFrame([(1, good, None, None, None), (2, bad, None, None, None), (3, None, None, None, None), (4, "", None, None, None)], SCHEMA), weights).collect()}
    assert got[1] > 0.8 and got[2] < 0.2 and got[3] == got[4] and 0 <= got[3] <= 1
    assert classifier.score(docs, weights).count() == docs.count() and classifier.score(empty, weights).count() == 0
    assert not classifier.fit(empty, labels).any()
    index, value = classifier.features(b"word word word word")
    assert len(index) == 3 and np.dot(value, value) == pytest.approx(1)
    assert set(classifier.features(b"a b")[0]) != set(classifier.features(b"b a")[0])


def test_plain_classifier(docs, spark):
    """Training and scoring against loops over numbers."""
    rows = [(*classifier.features(t.encode(), 10), k % 2) for k, t in enumerate([r.text for r in docs.collect() if r.text][:40])]
    alpha, beta, l1, l2, z, n = 0.5, 1.0, 0.001, 0.1, collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            index, value, label = rows[k]
            x = {int(i): float(v) for i, v in zip(index, value)} | {1 << 10: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got = classifier.train_ftrl(rows, 10)
    assert got == pytest.approx([weight(i) for i in range((1 << 10) + 1)], abs=1e-4)
    for r in classifier.score(docs.withColumn("t", F.col("text")), got).collect():
        index, value = classifier.features(None if r.t is None else r.t.encode(), 10)
        assert r.score == pytest.approx(1 / (1 + np.exp(-sum(float(got[i]) * float(v) for i, v in zip(index, value)) - float(got[-1]))), abs=1e-6)


def test_classifier_samples(spark):
    docs = spark.createDataFrame([(k, f"a b {k}") for k in range(30)] + [(3, "other"), (3, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    one = classifier.fit(docs, labels, bits=8)
    assert (one == classifier.fit(docs.repartition(7), labels.repartition(2), bits=8)).all()  # of several texts always the same
    assert not classifier.fit(docs, labels, max_mb=0, bits=8).any()
