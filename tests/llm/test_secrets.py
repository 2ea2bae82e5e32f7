import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import secret_scan as S

WORDS = {"password", "passwd", "secret", "token", "apikey", "api_key"}
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_assign(text):
    """The first rule, character by character, without regular expressions."""
    out, at = [], 0
    while at < len(text):
        ends = []
        for w in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if lower(text[at : at + len(w)]) == w:
                ends.append(at + len(w))
        hit = None
        for p in ends:
            for q in ([p + 1] if text[p : p + 1] and text[p] in "\"'" else []) + [p]:
                i = q
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] and text[i] in "\"'":
                    i += 1
                j = i
                while j < len(text) and text[j] in VALUE:
                    j += 1
                if j > i:
                    hit = (at, j, i)
                    break
            if hit:
                break
        if hit:
            out += [hit] if hit[1] - hit[2] >= 6 else []
            at = hit[1]
        else:
            at += 1
    return [(a, "assign", b) for a, b, _ in out]


def brute_runs(text, kind):
    out, at = [], 0
    while at < len(text):
        head = text[at : at + 4] == "AKIA" if kind == "access" else True
        chars, skip, least = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 4, 20) if kind == "access" else ("0123456789abcdef", 0, 24)
        j = at + skip
        while head and j < len(text) and text[j] in chars:
            j += 1
        if head and j > at + skip:
            out += [(at, kind, j)] if j - at >= least else []
            at = j
        else:
            at += 1
    return out


def brute(text):
    found = brute_assign(text) + brute_runs(text, "access") + brute_runs(text, "hex")
    return sorted(found, key=lambda s: (s[0], S.KINDS.index(s[1])))


def hexes(r, n):
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


PIECES = ["password", "PassWd", "secret", "TOKEN", "api_key", "APIKEY", "api-key", "toKen", "ſecret", '"', "'", " ", "  ", ":", "=", "==", "abc", "hunter2", "A.b_c-d/e+f", "AKIA", "AKIA" + "Q7" * 8, "AKIA" + "Z" * 15, "é", "\n", "0123456789abcdef", "deadbeef" * 3, "ABCDEF", "Größe", "."]


def test_base_rules_match_plain_scanning():
    r = random.Random(4)
    hits = 0
    for _ in range(4000):
        t = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14)))
        got = [(a, S.KINDS[k], b) for a, k, b, _ in S.base_spans(t)]
        assert got == brute(t), t
        hits += len(got)
    assert hits > 1000


def test_candidates_touch_no_base_span():
    r = random.Random(5)
    for _ in range(2000):
        t = "".join(r.choice(PIECES + ["x" * 20]) for _ in range(r.randint(0, 14)))
        spans = S.base_spans(t)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t):
            x = m.group().strip(S.EDGES)
            if len(m.group()) >= S.LEAST_TOKEN and len(x) >= S.LEAST_TOKEN:
                a = m.start() + m.group().index(x)
                if not any(s < a + len(x) and e > a for s, _, e, _ in spans):
                    want.append((a, a + len(x)))
        assert S.candidates(t, spans) == want


def test_inferred_automaton_is_a_distribution_and_finds_the_grammar():
    r = random.Random(6)
    # letters and digits take turns: two states tell them apart, one can't
    lengths = [1 + int(r.expovariate(0.25)) for _ in range(800)]  # each pair may be the last with the same chance
    turns = ["".join(r.choice("ghij") + r.choice("12345") for _ in range(n)) for n in lengths]
    m = S.infer(turns)
    assert 2 <= len(m.step) <= 4
    for s in m.step:
        assert sum(math.exp(p) for p, _ in s.values()) <= 1 + 1e-9
    assert m.log_likelihood("g1h2i3j4") > m.log_likelihood("gghhii12") + 8
    assert m.fits("g1h2g1h2g1") > -math.inf == m.fits("1111gggg11")
    assert S.infer(turns[::-1]) == m and S.infer([]).log_likelihood("ab") < 0
    # one distribution throughout: one state
    assert len(S.infer([hexes(r, 40) for _ in range(500)]).step) == 1
    fixed = S.infer(["AKIA-" + "".join(r.choice("GHIJ") for _ in range(3)) for _ in range(400)])
    assert fixed.log_likelihood("AKIA-GGG") > fixed.log_likelihood("GGG-AKIA") + 10


def test_counts_of_merged_states(monkeypatch):
    """Merging keeps the number of visits, ends and ways in balance."""
    r = random.Random(8)
    tree = S.PrefixTree([S.classes(hexes(r, r.randint(1, 9))) for _ in range(60)])
    kids = list(tree.next[0].values())
    n = [sum(tree.through[k] for k in kids[:2]), sum(tree.ends[k] for k in kids[:2])]
    tree.merge(kids[0], kids[1])
    assert [tree.through[kids[0]], tree.ends[kids[0]]] == n
    todo = [kids[0]]
    while todo:
        s = todo.pop()
        assert tree.through[s] == tree.ends[s] + sum(tree.ways[s].values())
        todo += tree.next[s].values()


def corpus(n=300):
    r = random.Random(9)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.choice([3, 5, 8, 18, 25]))) for _ in range(400)]
    docs, loose = [], {}
    for i in range(n):
        w = [r.choice(words) for _ in range(40)]
        if i % 3 == 0:
            w.insert(5, f'token = "{hexes(r, 40)}"')
        if i % 30 == 1:
            loose[i] = hexes(r, 23)  # too short for the third rule
            w.insert(9, loose[i])
        docs.append((i, " ".join(w)))
    return docs, loose


def test_learned_formats_add_spans_and_leave_text_alone(spark):
    docs, loose = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, base string, _tokens int").repartition(4)
    got = {r["doc_id"]: r for r in S.find_secrets(df).collect()}
    texts = dict(docs)
    assert {i: [texts[i][s["start"] : s["end"]] for s in r["added"]] for i, r in got.items() if r["added"]} == {i: [x] for i, x in loose.items()}
    for i, r in got.items():
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == brute(texts[i])
        assert all(texts[i].endswith(s["value"], 0, s["end"]) for s in r["base"])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdef1"), (3, "token=abcdef1"), (None, "é password: " + "x" * 6), (4, ("a b" + " " * 50) * 20_000 + " secret='" + "Zz9" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((str(r["doc_id"]), [(s["start"], s["kind"], s["end"]) for s in r["base"]], r["added"]) for r in S.find_secrets(df).collect())
    assert got == sorted((str(i), brute(t or ""), []) for i, t in rows)
    assert S.find_secrets(df.limit(0)).collect() == []
    none = S.find_secrets(df.where("doc_id = 2")).first()
    assert none["base"] == [] and none["added"] == []


def test_redact_and_written(spark):
    df = spark.createDataFrame([("ab password=hunter22 é",), ("x deadbeef0123456789abcdef0 y token: deadbeef0123456789abcdef0",), ("",)], "text string")
    with_ids = df.withColumn("doc_id", F.monotonically_increasing_id())
    rows = S.find_secrets(with_ids).join(with_ids, "doc_id").select("text", S.written(F.col("base")).alias("w"), S.redact(F.col("text"), F.col("base")).alias("r")).collect()
    got = {r["text"]: (r["w"], r["r"]) for r in rows}
    for t, (w, red) in got.items():
        assert w == ",".join(f"{k}:{a}:{b}" for a, k, b in brute(t))
    assert sorted(r for _, r in got.values()) == ["", "ab [secret] é", "x [secret] y [secret]"]


def test_query_on_the_given_table(spark, sf):
    from corpusloom.llm.queries import op13_secrets

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in S.KINDS]
        base = [f"{k}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""} and len([x for x in r["spans"].split(",") if x]) == len(base) + r["n_added"]
