import random
import zlib

import numpy as np
from paths import SMALL

from causeway.llm import chat, pii, quality, queries, toxicity

LABEL = "doc_id long, quality int, toxic int"


def test_ordinal_grades(spark):
    """Four grades by the share of a word: the fit orders them, and probabilities fall with the grade."""
    rng = random.Random(1)
    texts, grades = [], []
    for _ in range(400):
        g = rng.randrange(4)
        texts.append(" ".join("good" if rng.random() < 0.1 + 0.25 * g else rng.choice(["red", "blue", "dull"]) for _ in range(60)))
        grades.append(g)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(i, g, 0) for i, g in enumerate(grades)], LABEL))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    rows = quality.score(df, model, at_least=2).orderBy("doc_id").collect()
    assert np.corrcoef([r.expected_grade for r in rows], grades)[0, 1] > 0.85 and np.mean([(r.tail_probability >= 0.5) == (g >= 2) for r, g in zip(rows, grades)]) > 0.9


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (0, 1, 0)], LABEL)
    table = docs("fine words here", "%%% %%% %%%", None, "").withColumnRenamed("source", "keep")
    model = quality.fit(table, labels)
    rows = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert rows[2].tail_probability == rows[3].tail_probability and rows[0].tail_probability > rows[1].tail_probability
    assert quality.select(table, model).columns == table.columns and quality.score(table.limit(0), model).count() == 0
    assert quality.score(table, quality.fit(table, labels.limit(0))).count() == 4


def test_quality_query(spark):
    """Held-out accuracy: half of the ratings are fitted, the other half scored."""
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    fold = quality.F.expr("pmod(xxhash64(doc_id, 'fold'), 2)")
    rows = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels.where(fold == 0))).join(labels.where(fold == 1), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.keep == r.quality for r in rows]) > 0.95
    assert queries.op3_ordinal_quality(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_quality_likelihood_against_a_search():
    """The fitted model is better than its neighbours by the penalised likelihood, computed plainly."""
    rng = np.random.default_rng(2)
    slots = [np.array(sorted(rng.choice(6, 3, replace=False))) for _ in range(120)]
    counts = [np.full(3, 1.0) for _ in slots]
    grades = np.array([min(2, int((s < 3).sum() * 0.8 + rng.random())) for s in slots])
    model = quality.fit_rows(slots, counts, grades, 3, bits=3, l2=0.01, steps=3000, rate=0.05)

    def loss(w, cut):
        total = 0.005 * (w * w).sum()
        for s, c, g in zip(slots, counts, grades):
            x = (w[s] * c).sum()
            below = lambda k: 1.0 if k == 3 else 0.0 if k == 0 else 1 / (1 + np.exp(-(cut[k - 1] - x)))
            total -= np.log(below(g + 1) - below(g)) / len(grades)
        return total

    best = loss(model.weights, model.thresholds)
    for _ in range(200):
        d, e = rng.normal(size=8) * 0.05, rng.normal(size=2) * 0.05
        assert loss(model.weights + d * (model.weights != 0), model.thresholds + e) > best - 1e-4
    assert model.thresholds[0] < model.thresholds[1]


def test_quality_repeats_and_clashes(spark):
    """Ids that repeat are one row of the fit; a very long text and columns of the result's names do no harm."""
    rows = [(i, f"good {i} text" if i % 2 else "%%% bad") for i in range(40)] + [(1, "good 1 text")] * 50 + [(99, "w" * 100_000 + " good" * 50_000)]
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, keep string, expected_grade string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0)] * 9, LABEL)
    once = quality.fit(docs.dropDuplicates(["doc_id"]), labels.dropDuplicates(["doc_id"]))
    model = quality.fit(docs, labels)
    assert np.array_equal(model.weights, once.weights) and quality.score(docs, model).columns == ["doc_id", "text", "expected_grade", "tail_probability", "keep"]
    assert quality.score(docs, model).count() == len(rows)


def test_toxicity(spark):
    rng = random.Random(3)
    bad, plain = ["vilewort", "vileness", "vilest"], ["stone", "river", "garden", "window", "yellow", "paper", "quiet", "summer"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(60)]
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, " ".join(plain * 7 + ["vilely"] * 4)), (1001, None), (1002, ""), (1003, " ".join(plain * 7 + ["stone"] * 4))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABEL)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.98
    assert got[1000].score > got[1003].score and got[1001].score == got[1002].score < 0.7 and len(got) == len(rows)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.F.crc32(toxicity.F.col("doc_id").cast("string")) % 3 == 1, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)  # held-out labels are never read


def test_kneser_ney_formula():
    """One ratio by hand: discounted counts plus the weight below times the shared trigram."""
    contexts = {"abc": (3, 1, 2, 1)}
    shared = {a + b + c: 1 + (a == c) for a in "abc" for b in "abc" for c in "abc"}
    ratio, backoff = toxicity._ratios([("abca", 2, 1), ("abcb", 1, 0)], contexts, shared)
    one = (12 + 1) / (36 + 3 + 256)  # as last characters all three are equally frequent
    two = (4 - 0.75) / 12 + 0.75 * 3 / 12 * one  # ca: the trigrams that begin with it hold 4 of the 12 that begin with c
    base = (1 - 0.75) / 4 + 0.75 * 3 / 4 * two  # bca: one of four, three kinds after bc
    p0, p1 = (2 - 0.75) / 3 + 0.75 * 2 / 3 * base, (1 - 0.75) / 1 + 0.75 * base
    assert np.isclose(ratio["abca"], np.log(p1 / p0)) and np.isclose(backoff["abc"], np.log(0.75 / 0.5))
    model = toxicity.Model(ratio, backoff, np.zeros(toxicity.FEATURES + 1))
    assert model.word("") == 0.0 and model.word("zzz") == 0.0 and np.isclose(model.word("xabcz"), backoff["abc"])


def test_stretches_are_compared_by_length():
    """The ratio by length of the whole and of the best stretches, by their definition."""
    model = toxicity.Model(toxicity.Grams(toxicity.hashes(["aaaa"]), np.array([2.0])), toxicity.Grams(toxicity.hashes(["aaa"]), np.array([0.0])), np.zeros(6))
    words = ["b"] * 30 + ["xaaaa"] * 3 + ["b"] * 7 + ["aaaaa"] * 2
    ratio = [model.word(w) for w in words]
    assert max(ratio) > 0
    want = [sum(ratio) / len(ratio)] + [max(sum(ratio[i : i + w]) for i in range(len(ratio) - w + 1)) / w for w in (1, 4, 16, len(ratio))] + [np.log1p(len(ratio))]
    assert np.allclose(model.features([" ".join(words), ""], model.lookup()), [want, [0] * 6])


def test_models_equal_brute_force(spark):
    """Kneser-Ney by its recursion on strings, from the labelled texts and the corpus's distinct words, against the fitted tables."""
    from collections import Counter

    rng = random.Random(21)
    ids = [i for i in range(150) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = {i: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(6)) for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], LABEL)
    model = toxicity.fit(docs.repartition(5), labels)
    fold = {r._id: r.f for r in docs.selectExpr("doc_id as _id", "pmod(xxhash64(doc_id), 3) as f").collect()}
    S, E, D = toxicity.START, toxicity.END, toxicity.DISCOUNT
    shared = Counter()
    for w in {w for t in texts.values() for w in t.split()}:
        spelled = S + w + E
        for at in range(len(spelled) - 2):
            shared[spelled[at : at + 3]] += 1  # every place of a distinct word
    level = {c: {n: Counter() for n in range(2, 7)} for c in (0, 1)}
    for i, t in texts.items():
        if fold[i]:
            for w in set(t.split()):
                spelled = S + w + E
                for end in range(2, len(spelled) + 1):
                    g = spelled[max(0, end - 6) : end]
                    if len(g) == 6 or g[0] == S:
                        level[i % 2][len(g)][g] += 1
    for c in (0, 1):  # lower orders: kinds of what stands before; at a word's start, documents
        for n in (5, 4):
            for g in level[c][n + 1]:
                level[c][n][g[1:]] += 1

    def backoff(g):
        if len(g) == 1:
            last, every = Counter(), sum(shared.values())
            for x, k in shared.items():
                last[x[2]] += k
            return (last[g] + 1) / (every + len(last) + 256)
        if len(g) == 2:
            n = sum(k for x, k in shared.items() if x[:2] == g)
            all_, kinds = sum(k for x, k in shared.items() if x[0] == g[0]), len({x[1] for x in shared if x[0] == g[0]})
        else:
            n, all_, kinds = shared[g], sum(k for x, k in shared.items() if x[:2] == g[:2]), len({x[2] for x in shared if x[:2] == g[:2]})
        return max(n - D, 0) / all_ + D * kinds / all_ * backoff(g[1:]) if all_ else backoff(g[1:])

    def p(c, g):
        if len(g) < 4 and g[0] != S or len(g) == 1:
            return backoff(g)
        table = level[c][len(g)]
        total, kinds = sum(k for x, k in table.items() if x[:-1] == g[:-1]), sum(x[:-1] == g[:-1] for x in table)
        return max(table[g] - D, 0) / total + D * kinds / total * p(c, g[1:]) if total else p(c, g[1:])

    grams = sorted({g for c in (0, 1) for n in level[c] for g in level[c][n]})
    got, held = model.ratio.find(toxicity.hashes(grams))
    assert held.all() and len(model.ratio) == len(grams)
    some = [i for i in range(len(grams)) if i % 5 == 0 or len(grams[i]) < 5]
    assert np.allclose(got[some], [np.log(p(1, grams[i]) / p(0, grams[i])) for i in some])


def test_scores_do_not_depend_on_the_layout(spark):
    sf = SMALL
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "word"), (7, "x" * 10_000 + " " + "y" * 70_000)], "doc_id long, text string")).withColumn("score", toxicity.F.lit("clash"))
    found = []
    for parts in (1, 7, 211):
        rows = toxicity.score_documents(extra.repartition(parts), labels.repartition(3)).collect()
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.score, r.predicted, r.held_out) for r in rows))
    assert found[0] == found[1] == found[2] and sum(x[0] for x in found[0]) == 1 and not any(x[4] for x in found[0] if x[0])


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], LABEL)
    assert [r.predicted for r in toxicity.score_documents(docs("a b c", None), none).collect()] == [0, 0] and toxicity.score_documents(docs("a").limit(0), none).count() == 0


def test_personal_data_scan():
    spans, loose = pii.matches("mail a.b@c-d.org or 4111 1111 1111 1111, 10.0.0.255, +1 (212) 555-1234; 1.2.3.999 me@host 4111 1111 1111 1112")
    assert pii.shown(spans) == "email:5:16,card:20:39,ip:41:51,phone:53:70" and [k for _, k, _ in loose] == [1, 3, 0, 2]
    text = "ask jo at host dot com, or (0171) 234 56-78; fe80:0:0:1:2 token=ab12cd34ef56ab78, 12a34567"
    assert pii.matches(text)[0] == [] and [(pii.NAMES[k], text[s:e]) for s, k, e in pii.matches(text)[1]] == [
        ("email", "jo at host dot com"), ("phone", "(0171) 234 56-78"), ("ip", "fe80:0:0:1:2"), ("secret", "ab12cd34ef56ab78"), ("secret", "12a34567")]
    long = "w" * 5000
    assert pii.contexts(f"see {long} at 1.2.3.4", 9 + 5000 - 1, 9 + 5000 + 6)[1].startswith("see #") and pii.contexts(f"x{long} 5", 5002, 5003) == []


def test_bootstrapping(spark):
    rows = [(i, f"please call number {'+1 (212) 555-%04d' % i if i < 60 else '(212) 555-%04d' % i} today") for i in range(70)]
    rows += [(100 + i, f"order {'4111111111111111' if i % 2 else '4111111111111112'} shipped, batch (212) 555-{7000 + i}") for i in range(40)] + [(200, None), (201, ""), (202, "a@b.cd")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, spans string, pattern string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert all(got[i].spans == "phone:19:36" and got[i].n_found == 0 for i in range(60)) and all(got[i].n_phone == 0 and got[i].spans == "phone:19:33" and got[i].n_found == 1 for i in range(60, 70))
    assert all(got[100 + i].n_found == 0 for i in range(40)) and got[200].spans == got[201].spans == "" and got[202].spans == "email:0:6"
    assert sorted(pii.redact(df).collect()) == sorted(pii.redact(df, broadcast_patterns=0).collect())
    assert {r.text for r in pii.redact(df).where("doc_id = 65").collect()} == {"please call number <phone> today"} and pii.find(df.limit(0)).count() == 0
    assert pii.redact(df).columns == df.columns and pii.find(df.union(df)).count() == 2 * df.count()


def _planted(n: int = 600, seed: int = 5):
    """Texts with identifiers of the fixed and of other forms in telling contexts, and numbers and names of no person in others."""
    rng = random.Random(seed)
    word = lambda: rng.choice("amber basin cedar delta ember fjord grove haven inlet jetty knoll lagoon".split())
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    phones = [lambda: f"+49 {digits(3)} {digits(7)}", lambda: f"0171/{digits(7)}", lambda: f"030 {digits(7)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"]
    mails = [lambda: f"{word()}.{digits(2)}@{word()}.org", lambda: f"{word()}{digits(2)} at {word()} dot com", lambda: f"{word()}{digits(3)}@{word()}"]
    ips = [lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: ":".join(f"{rng.randrange(1, 1 << 16):x}" for _ in range(6)), lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(300, 999)}"]
    secrets = [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(24)) + "a1", lambda: f"Tr{digits(3)}-{word()}{digits(4)}"]
    told = [(3, phones, ["reach me by phone: {} any day", "mobile number {} works"]), (0, mails, ["write to mail address {} please", "e-mail: {} or so"]), (1, ips, ["client ip {} connected", "login from host {} today"]), (4, secrets, ['api token = "{}" set', "password={} kept"])]
    rows, want = [], set()
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 30)))]
        kind, forms, slots = rng.choice(told)
        value = forms[0]() if rng.random() < 0.75 else rng.choice(forms[1:])()
        parts.append(rng.choice(slots).format(value))
        parts.append(rng.choice(["invoice no {} was paid", "part {} is in stock", "build {} has passed"]).format(rng.choice([f"0171/{digits(7)}", digits(9), f"x{digits(4)}-{word()}9", ".".join(digits(3) for _ in range(4))])))
        rng.shuffle(parts)
        text = " . ".join(parts)
        rows.append((i, text))
        at = text.index(value)
        want.add((i, pii.NAMES[kind], at, at + len(value)))
    return rows, want


def test_unseen_identifiers_are_found_in_context(spark):
    """Recall of identifiers of unseen forms, and precision, on planted texts."""
    rows, want = _planted()
    got = set()
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for x in filter(None, (r.spans + "," + r.secrets).split(",")):
            kind, s, e = x.split(":")
            got.add((r.doc_id, kind, int(s), int(e)))
    text = dict(rows)
    unseen = {w for w in want if not any((s, pii.KINDS[k], e) == (w[2], w[1], w[3]) for s, k, e in pii.matches(text[w[0]])[0]) and not pii.is_seed(pii.NAMES.index(w[1]), text[w[0]][w[2] : w[3]])}
    assert len(unseen) > 120 and len(unseen & got) > 0.9 * len(unseen) and len(got & want) > 0.95 * len(got)


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(2), f"p{rng.randrange(12)}", rng.randrange(60)) for _ in range(400)}
    seeds = {(k, i) for k in (0, 1) for i in range(60) if rng.random() < 0.75}
    kept = [(k, p, i, (k, i) in seeds) for k, p, i in edges]
    frame = spark.createDataFrame(kept + kept[:50], "kind int, pattern string, instance long, seed boolean")
    asked = {}
    for k in (0, 1):
        own = {i for kk, _, i, _ in kept if kk == k}
        p0 = len({i for i in own if (k, i) in seeds}) / len(own)
        asked[k] = min(pii.TRUST, max(pii.LEAST, p0 + (1 - p0) / 4))
    for rounds in (1, 2, 4):
        conf = {(k, i): float(s) for k, _, i, s in kept}
        for _ in range(rounds):
            trusted = {}
            for k, p in {x[:2] for x in kept}:
                found = [conf[k, i] for kk, pp, i, _ in kept if (kk, pp) == (k, p)]
                n, share = len(found), sum(found) / len(found)
                z = pii.Z
                c = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if round(c, 9) >= asked[k]:
                    trusted[k, p] = c
            conf = {(k, i): 1.0 if s else max((trusted.get((k, p), 0.0) for kk, p, ii, _ in kept if (kk, ii) == (k, i)), default=0.0) for k, _, i, s in kept}
        got = {(r.kind, r.pattern): r.confidence for r in pii.score_graph(frame, rounds=rounds).collect()}
        assert got.keys() == trusted.keys() and len(trusted) > 2 and all(abs(got[x] - trusted[x]) < 1e-6 for x in got)


def test_pii_query_against_patterns(spark):
    import hashlib
    import re

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def good(k, s):
        digits = re.sub("[^0-9]", "", s)
        return (k != 1 or max(map(int, s.split("."))) <= 255) and (k != 2 or 14 <= len(digits) <= 19 and pii.luhn(digits)) and (k != 3 or 10 <= len(digits) <= 15)

    sf = SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op2_bootstrapped_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, d.text) if good(k, m[0]))
        assert got[d.doc_id].base_sha256 == hashlib.sha256(pii.shown(spans).encode()).hexdigest()
        assert set(filter(None, pii.shown(spans).split(","))) <= set(got[d.doc_id].spans.split(","))


def test_chat_blocks_equal_one_pass(spark):
    """Blocked decoding gives the path of plain Viterbi over the whole transcript."""
    rng = np.random.default_rng(5)
    names = ["user", "assistant"]
    rows = [(1, t, ("" if rng.random() < 0.3 else f"{names[t % 2].title()}: ") + "\n".join(f"line {rng.integers(99)}" for _ in range(rng.integers(1, 4))), names[t % 2]) for t in range(400)]
    rows += [(2, t, f"Human: q{t}?" if t % 2 == 0 else f"Bot: a{t}", names[t % 2]) for t in range(6)] + [(3, 0, None, "system")]
    raw = spark.createDataFrame(rows, "conv_id long, turn long, text string, true_role string")
    model = chat.fit(raw, role="true_role")
    got = chat.parse(raw, model).orderBy("conv_id", "turn_no").collect()
    lines = [x for r in sorted((r for r in rows if r[0] == 1), key=lambda r: r[1]) for x in r[2].split("\n")]
    states = model.paths([chat.codes(lines)])[0]
    want = [chat.STATES[s][0] for s in states if chat.STATES[s][1]]
    assert [r.role for r in got if r.conv_id == 1] == want
    assert [(r.turn_no, r.role, r.text) for r in got if r.conv_id == 2][:2] == [(0, "user", "q0?"), (1, "assistant", "a1")]
    assert got[-1].text == "" and got[-1].conv_id == 3 and got[0].rendered.startswith("<|") and chat.parse(raw.limit(0), model).count() == 0


def test_paths_are_the_best_of_all():
    """Against every sequence of states, by the plain sum of log-probabilities."""
    import itertools

    rng = np.random.default_rng(7)
    emit = [np.log(rng.dirichlet(np.ones(len(v)), len(chat.STATES))) for v in chat.FEATURES]
    start, step = np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6))
    model = chat.Model(start, step, emit)
    samples = ["User: hi?", "plain", "- item", "", "x" * 300, "### Assistant: yes", "[weird] : no"]
    blocks = [[samples[i] for i in rng.integers(0, len(samples), rng.integers(1, 6))] for _ in range(25)]

    def total(lines, states):
        value = start[states[0]]
        for n, (line, s) in enumerate(zip(lines, states)):
            value += sum(emit[f][s, v] for f, v in enumerate(chat.features(line))) + (step[states[n - 1], s] if n else 0)
        return value

    for lines, states in zip(blocks, model.paths([chat.codes(x) for x in blocks])):
        assert np.isclose(total(lines, states), max(total(lines, t) for t in itertools.product(range(6), repeat=len(lines))))


def test_chat_edges(spark, monkeypatch):
    """Null ids and numbers, repeated rows, equal numbers, a very long text, an empty table and clashing columns."""
    rows = [(1, 0, "User: a"), (1, 1, "Bot: b"), (2, 0, "User: x"), (2, 0, "User: x"), (2, 0, "Bot: w"), (None, 0, "User: n"), (None, 5, "User: n"), (3, None, "Bot: z"), (3, 1, None), (4, 0, "User: " + "line\n" * 9000 + "Bot: end"), (5, -70, "User: p"), (5, 70, "Bot: q")]
    raw = spark.createDataFrame([(*r, "r", "t", 9) for r in rows], "conv_id long, turn long, text string, role string, rendered string, block int")
    labelled = spark.createDataFrame([(i, t, f"{r.title()}: {w}" if t < 2 else w, r) for i in range(30) for t, (r, w) in enumerate([("user", "line"), ("assistant", "b")])], "conv_id long, turn long, text string, true_role string")
    model = chat.fit(labelled, role="true_role")
    got = {}
    for r in chat.parse(raw, model).collect():
        got.setdefault(r.conv_id, []).append((r.turn_no, r.role, r.text))
    assert sorted(got[1]) == [(0, "user", "a"), (1, "assistant", "b")] and sorted(got[2])[0] == (0, "assistant", "w") and sum(t[2].count("x") for t in got[2]) == 2
    assert sorted(got[None]) == [(0, "user", "n"), (0, "user", "n")] and sorted(t[::2] for t in got[3]) == [(0, ""), (0, "z")]
    assert sorted(got[5]) == [(0, "user", "p"), (1, "assistant", "q")] and sum(t[2].count("line") for t in got[4]) == 9000
    whole = sorted(chat.parse(raw, model).collect(), key=str)
    monkeypatch.setattr(chat, "LINES", 7)
    assert sorted(chat.parse(raw, model).collect(), key=str) == whole
    assert chat.parse(raw.limit(0), model).count() == 0 and chat.parse(raw, chat.fit(labelled.limit(0), role="true_role")).count() > 0


def test_chat_query(spark):
    """On transcripts that the model has not counted."""
    sf = SMALL.replace("0.001", "0.01")
    raw = chat.as_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    fold = chat.F.expr("pmod(xxhash64(conv_id, 'fold'), 2)")
    held = raw.where(fold == 1)
    got = chat.parse(held, chat.fit(raw.where(fold == 0), role="true_role"))
    n = held.groupBy("conv_id").count().join(got.groupBy("conv_id").count().withColumnRenamed("count", "m"), "conv_id").collect()
    assert len(n) == held.select("conv_id").distinct().count() and np.mean([r["count"] == r["m"] for r in n]) > 0.7
    pairs = held.join(got.selectExpr("conv_id", "turn_no as turn", "role as found"), ["conv_id", "turn"]).collect()
    assert np.mean([r.true_role == r.found for r in pairs]) > 0.95
    assert queries.op1_chat_hmm(spark, sf).select("conv_id").distinct().count() == raw.select("conv_id").distinct().count()


def _spelled(word, ratio, backoff):
    """The score of a word of any length, by its definition."""
    s, total = toxicity.START + word + toxicity.END, 0.0
    for end in range(2, len(s) + 1):
        for at in range(max(0, end - toxicity.HIGH), max(1, end - toxicity.LOW + 1)):
            if s[at : end - 1] in backoff:
                if s[at:end] in ratio:
                    total += ratio[s[at:end]]
                    break
                total += backoff[s[at : end - 1]]
    return total


def test_long_tokens_are_scored_whole(spark, monkeypatch):
    """A toxic word after character 64 of a token without white space counts, and pieces of a token add up to it."""
    rng = random.Random(9)
    grams = {toxicity.START * (i % 2) + "".join(rng.choice("abß好") for _ in range(rng.randrange(2, 6))) for i in range(300)}
    ratio = {g: rng.random() for g in grams if len(g) < 7 and (len(g) >= 4 or g[0] == toxicity.START)}
    backoff = {g[:-1]: rng.random() for g in ratio}
    model = toxicity.Model(*(toxicity.Grams(toxicity.hashes(d), np.array(list(d.values()))) for d in (ratio, backoff)), np.zeros(7))
    words = ["", "a", "ab", *("".join(rng.choice("abß好z") for _ in range(n)) for n in (3, 4, 5, 6, 63, 65, 200, 1000))]
    want = [_spelled(w, ratio, backoff) if w else 0.0 for w in words]
    for piece in (1 << 16, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(model.words(words), want)
    monkeypatch.undo()
    late = "z" * 100
    assert not np.isclose(model.word(late + max(ratio, key=len)), model.word(late + "zzzzz"))


def test_shared_counts_are_of_distinct_words(spark):
    """However the rows lie in tasks, a trigram counts each word of the corpus once, and no row is cut."""
    rows = [(i, "the lathe bathe, The (lathe) " + "x" * 80 + "qjv") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (1, 8):
        got = {r.code: r.n for r in toxicity._trigrams(docs.repartition(parts), "text").collect()}
        assert got[toxicity._code(*map(ord, "the"))] == 3 and got[toxicity._code(*map(ord, "qjv"))] == 1
        found.append(got)
    assert found[0] == found[1]
    some = toxicity._shared(docs, "text", ["\x02the", "lathe", "\x02l"])
    whole = toxicity.Shared.of({chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF): n for c, n in found[0].items()})
    assert np.allclose(some.probability(["the", "the"[1:], "l"]), whole.probability(["the", "he", "l"]))


def test_grams_seen_once_are_held(spark):
    """The n-grams of a word that one toxic document holds once are in the model."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    words = {i: "".join(chr(97 + (i * 7 + k * k + k) % 26) for k in range(8)) for i in ids}
    docs = spark.createDataFrame([(i, f"stone river {words[i]}") for i in ids], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in ids], LABEL))
    alone = toxicity.hashes([words[i][1:7] for i in ids])
    assert model.ratio.find(alone)[1].mean() > 0.5


def test_toxicity_fit_holds_numbers_of_all_and_strings_of_a_block(monkeypatch):
    """What the driver takes grows by less than 200 bytes an n-gram, and no block changes a ratio."""
    import tracemalloc

    import pyarrow as pa

    rng, n = random.Random(3), 200_000
    grams = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)})
    contexts = list({g[:-1] for g in grams})
    numbers = lambda k, of: [pa.array([rng.randrange(1, 3) for _ in of]) for _ in range(k)]
    held, totals = pa.table([pa.array(grams), *numbers(2, grams)], names=["g", "n0", "n1"]), pa.table([pa.array(contexts), *numbers(4, contexts)], names=["c", "t0", "t1", "k0", "k1"])
    common = toxicity.Shared.of({g[-3:]: 1 for g in grams})
    tracemalloc.start()
    ratio, backoff = toxicity._ratios(held, totals, common)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * (len(grams) + len(contexts)), most
    for block in (1 << 30, 1000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        again = toxicity._ratios(held, totals, common)
        assert all((a.keys == b.keys).all() and (a.values == b.values).all() for a, b in zip((ratio, backoff), again))
