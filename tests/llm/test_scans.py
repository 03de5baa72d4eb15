import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii, quality, secret_scan, url_filter

from .cases import LONG, awkward, empty


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def held(rows, spans):
    want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in spans) == want


def test_base_spans_are_those_of_the_patterns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pii.op1_pii(spark, sf).collect()
    held(docs.collect(), out)
    assert sum(r.n_email for r in out) > 5 and sum(r.n_card for r in out) > 5 and sum(r.n_ip for r in out) > 5


def test_base_spans_of_random_texts(spark):
    draw = random.Random(3)
    alphabets = ["a@.-%b ", "0123. ", "+1 ()-.7", "4 -0", "12@.é\U0001f600+ \n"]
    texts = ["".join(draw.choices(draw.choice(alphabets), k=draw.randint(0, 60))) for _ in range(600)]
    texts += ["a@b.c%d@e.f", "x@y..z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+44 (0)20 7946 0958.", "\U0001f600 a@b.co", "1" * 5000, "a" * 100_000, "+1" + "(" * 5000, "a@" + "b." * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held(docs.collect(), pii.digest(pii.find(docs)).collect())


def test_contexts_discover_identifiers(spark):
    names = [f"user{i}@mail.example.com" for i in range(8)]
    rows = [(i, f"some words then please write to {n} for more") for i, n in enumerate(names)]
    rows += [(100, "they said please write to jane(at)example.org for more"), (101, "the value of 123456 for more"), (102, "please write 4444 now")]
    out = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    at = rows[8][1].index("jane")
    assert out[100].spans == f"email:{at}:{at + 19}" and out[100].n_email == 0 and out[100].n_added == 1
    assert out[101].n_added == 0 and out[102].n_added == 0 and all(out[i].n_email == 1 for i in range(8))


def test_found_instances_are_seeds_of_the_next_round(spark):
    """A context that no base match meets, only three instances found in the first round and one more."""
    rows = [(i, f"then please write to user{i}@mail.example.com for more") for i in range(8)]
    rows += [(10 + i, f"then please write to p{i}(at)example.org for more, or reach me under p{i}(at)example.org always") for i in range(3)]
    rows += [(20, "or reach me under q(at)example.org always"), (21, "or reach us over r(at)example.org never")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = lambda n: {r.doc_id: r.n_added for r in pii.digest(pii.find(docs, rounds=n)).collect()}
    assert added(1) == dict.fromkeys(range(8), 0) | dict.fromkeys(range(10, 13), 2) | {20: 0, 21: 0}
    assert added(2) == added(3) == dict.fromkeys(range(8), 0) | dict.fromkeys(range(10, 13), 2) | {20: 1, 21: 0}


def test_contexts_go_across_neighbouring_matches(spark):
    """The second of two identifiers has words before it, and no word is too long or far."""
    wide, long = "\n" * 400, "z" * 300
    rows = [(i, f"mail {long}{wide} user{i}@mail.example.com or user{i}@old.example.org to reach") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.matches(docs, "doc_id", "text", {"email": pii.BASE["email"]}, "t").filter("kind is not null").collect()
    assert {(r.before, r.after) for r in got} == {(f"mail {long}{wide} ", " or"), ("<email> or ", " to")}
    more = spark.createDataFrame([*rows, (9, "or so <email> or john(at)example.org to reach"), (10, f"mail {long}{wide} jim(at)example.org or x")], "doc_id long, text string")
    out = {r.doc_id: r.n_added for r in pii.digest(pii.find(more)).collect()}
    assert out == dict.fromkeys(range(5), 0) | {9: 1, 10: 1}


def test_scans_take_awkward_rows(spark):
    docs = awkward(spark)
    held(docs.collect(), pii.digest(pii.find(docs)).collect())
    assert pii.digest(pii.find(empty(spark))).count() == 0
    forest = secret_scan.train(secret_scan.labelled_findings(spark, 300))
    more = spark.createDataFrame([(50, "\U0001f600 my api_key = 'Zk3jQ9vX7pLm2TnB8sRw' and id 9233720368547758 and"), (51, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962"), (52, LONG + 'token: "ghp_0aB3dE6fG9hJ2kL5mN8pQ1rS4tU7vW0xY3zA"')], "doc_id long, text string")
    out = secret_scan.scan(more, forest).collect()
    text = {r.doc_id: r.text for r in more.collect()}
    assert all(text[r.doc_id][r.start : r.end] == r.match for r in out)
    assert [(r.doc_id, r.match[:4], r.secret) for r in sorted(out, key=lambda r: (r.doc_id, r.start)) if len(r.match) > 15] == [(50, "Zk3j", True), (50, "9233", False), (51, "04db", False), (52, "ghp_", True)]
    assert secret_scan.scan(docs, forest).count() >= 0 and secret_scan.scan(empty(spark), forest).count() == 0


def brute_features(match, before, after):
    """The features of a finding in plain Python."""
    n, before, after = len(match), before.lower(), after.lower()
    shape = "".join("a" if c in string.ascii_lowercase else "B" if c in string.ascii_uppercase else "9" if c in string.digits else "~" for c in match)
    moves = max(n - 1, 1)
    logs, held = secret_scan.pair_logs(), []
    for x, y in zip(match.lower(), match.lower()[1:]):
        if x in string.ascii_lowercase and y in string.ascii_lowercase:
            held.append(logs[(ord(x) - 97) * 26 + ord(y) - 97])
    left = match.lower()
    left = re.sub("|".join(sorted(secret_scan.DICTIONARY, key=lambda w: (-len(w), w))), "", left)
    pairs = [x + y for x, y in zip(shape, shape[1:])]
    word = lambda side, words: float(any(re.search(rf"(?<![a-z]){re.escape(w)}(?![a-z])", side) for w in words))
    return [
        n, sum(held) / max(len(held), 1), sum(x[0] != x[1] for x in pairs) / moves, *(pairs.count(p) / moves for p in secret_scan.PAIRS), sum(c in string.digits for c in match) / n, sum(c in string.ascii_uppercase for c in match) / n,
        float(all(c in "0123456789abcdef" for c in match)), len(set(match)) / min(n, 64), 1 - len(left) / n, sum(c in "_/.-" for c in match) / n,
        float(bool(re.search("/.*/", match) or re.search(r"://|/\s*\Z|\\\s*\Z", before))), word(before, secret_scan.SECRET_WORDS), word(before, secret_scan.PLAIN_WORDS), word(after, secret_scan.SECRET_WORDS), word(after, secret_scan.PLAIN_WORDS),
        float(before.rstrip()[-1:] in ('"', "'", "`") and before.rstrip() != ""), float(bool(re.search(r"[=:]\s*[\"'`]?\s*\Z", before))), float(match.startswith(secret_scan.PROVIDERS)), float(bool(re.search(r"(.)\1{4}|12345|abcdef", match))),
    ]


def test_features_are_those_of_plain_python(spark):
    rows = [(r.match, r.before, r.after) for r in secret_scan.labelled_findings(spark, 300).collect()]
    rows += [("x" * 8, "", ""), ("a1" * 500, "see the file ", " key"), ("--------1", "C:\\\\", "."), ("abcdefgh1", "api_key='", "'")]
    df = spark.createDataFrame(rows, "match string, before string, after string")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in df.select("match", "before", "after", *secret_scan.features()).collect()}
    for row in rows:
        assert got[row] == pytest.approx(brute_features(*row)), row
    assert len(secret_scan.FEATURES) == len(brute_features(*rows[0]))


def test_neighbours_of_findings_are_whole(spark):
    """Words on both sides, however far off and of whatever length, and across a neighbouring finding."""
    wide, long = " " * 500, "é" * 300
    rows = [(1, f"the {long} token ={wide}'Zk3jQ9vX7pLm2TnB' {wide}of the key"), (2, "password: aaaa1111 bbbb2222"), (3, "aaaa1111")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.match): (r.before, r.after) for r in secret_scan.matches(df, "doc_id", "text", {"secret": (secret_scan.CANDIDATE, None)}, "t", letters=True).filter("kind is not null").collect()}
    assert got[1, "Zk3jQ9vX7pLm2TnB"] == (f" {long} token ={wide}'"[1:], f"' {wide}of the")
    assert got[2, "aaaa1111"] == ("password: ", " <secret>") and got[2, "bbbb2222"] == ("password: <secret> ", "")
    assert got[3, "aaaa1111"] == ("", "")


def test_forest_on_findings_it_has_not_seen(spark):
    every = secret_scan.labelled_findings(spark, 2000)
    part = F.pmod(F.xxhash64("match"), F.lit(4)) == 0
    forest = secret_scan.train(every.filter(~part))
    judged = secret_scan.judge(every.filter(part), forest)
    n, right = judged.agg(F.count("*"), F.count_if(F.col("secret") == (F.col("label") == 1))).first()
    assert n > 500 and right / n > 0.93


#: Shapes and neighbours that the labelled findings don't have.
OTHERS = [
    ("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P", "curl -H Authorization: Bearer ", "", 1), ("SG.ngeVfQFYQlKU0ufo8x5d1A.TwL2iGABf9DHoTf09kqeF8tAmbihYzrnopKc", "SENDGRID_API_KEY=", "", 1),
    ("T00000000/B11111111/XXq9rT4LwzP0ak3Jd8", "webhook https://hooks.example.com/services/", "", 1), ("Tr0ub4dor-3xyz", "db password is ", " since", 1), ("JBSWY3DPEHPK3PXP4T6O", "totp secret ", " base32", 1),
    ("f47ac10b-58cc-4372-a567-0e02b2c3d479", "the client secret: '", "'", 1), ("dG9rZW46c2VjcmV0LXZhbHVlLTk4NzY1", "auth: Basic ", "", 1), ("pk_test_51Hq9LkJ2eZvKYlo2C8xYz", "stripe key ", "", 1), ("q7Wd93kfLs02mZx8", "passwd=", "&user", 1),
    ("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", "sha256sum prints ", " file.iso", 0), ("3f2a9c1b7e6d5f40", "index ", "..8d7e6f5 of file", 0), ("2024-03-05T12:30:45Z", "updated at ", " by cron", 0), ("978-3-16-148410-0", "isbn ", "", 0),
    ("1.18.0-alpine3.19", "the build of version ", "", 0), ("org.example.project.module.ClassName2", "import ", ";", 0), ("node_modules/react-dom/index.js", "in the file ", " line 5", 0), ("550e8400-e29b-41d4-a716-446655440000", "request id ", " took", 0),
    ("2001-0db8-85a3", "order number ", "", 0), ("user_profile_image_2_small", "the column ", " of table", 0), ("4532015112830366", "paid by card ", "", 0), ("iVBORw0KGgoAAAANSUhEUgAA", "image data of png ", "", 0), ("10.0.0.255", "from server ", "", 0),
]


def test_shapes_that_were_not_in_training(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    rows = secret_scan.judge(spark.createDataFrame(OTHERS, "match string, before string, after string, label int"), forest).collect()
    hit = sum(r.secret and r.label for r in rows)
    precision, recall = hit / max(1, sum(r.secret for r in rows)), hit / sum(r.label for r in rows)
    print("precision", precision, "recall", recall, [(r.match[:20], r.score, r.label) for r in rows if r.secret != bool(r.label)])
    assert precision >= 0.7 and recall >= 0.7


def test_planted_secrets_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = {r.doc_id for r in docs.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).collect()}
    got = secret_scan.op6_secrets(spark, sf).collect()
    assert planted and planted <= {r.doc_id for r in got if r.secret}
    assert not any(r.secret for r in got if r.match.isdigit())


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = re.match(r"[^?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in cut.split("/", 1)[0])
    path = cut[len(cut.split("/", 1)[0]) :]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bare = re.sub(r"\.$", "", re.sub(r":\d*$", "", host))
    listed = any(bare == u[7:-1] or bare.endswith("." + u[7:-1]) for u in url_filter.LISTED)
    return host, path, None, "block" if listed else "allow"


def test_urls_by_rule_and_list(spark):
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://COM/en/", "http://a.com/en/1", "http://example.com/en/7", "http://x.example.com/en/79?x=1", "http://EXAMPLE.net/de/8#t", "http://b.net/de/", "http://acom/en/", "http://spam-farm.example.com", "https://www.Cheap-Pills.example.com:8080/fr/1/", "http://casino-win.example.org./x", "http://notspam-farm.example.com/", "http://x.org/es", "http://x.org/es/\nb", "http://a://b/c", "http://é.org/ES/", "http://u@x.org/es/1"]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)] + [(3, "http://", "x", "y", "z")], "page_id long, url string, host string, key string, rule string")
    listed = spark.createDataFrame([(u,) for u in [*url_filter.LISTED, None, "x"]], "url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).select("page_id", "host", "path", F.coalesce("rule", F.lit("")).alias("rule"), "verdict").collect())
    assert got == sorted((i, h, p, r or "", v) for i, u in [*enumerate(urls), (3, "http://")] for h, p, r, v in [verdict(u)])
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert url_filter.judge(pages, listed.limit(0)).filter("verdict = 'block' and rule is null").count() == 0


def test_bloom_passes_all_that_is_listed(spark):
    urls = [(f"http://h{i % 50}.test/p/{i}",) for i in range(2000)]
    listed = spark.createDataFrame(urls, "url string")
    pages = spark.createDataFrame([(i, u[0] + "/?q") for i, u in enumerate(urls)] + [(9000 + i, f"http://h{i % 50}.test/q/{i}") for i in range(2000)], "page_id long, url string")
    blocked = {r.page_id for r in url_filter.judge(pages, listed, ()).filter("verdict = 'block'").collect()}
    assert blocked == set(range(2000))
    keys = url_filter.listed_keys(listed)
    n = keys.count() * url_filter.BITS // 256
    table = url_filter.bloom(keys, n)
    probed = spark.range(20_000).select(F.concat(F.lit("other/"), "id").alias("key")).select("*", *url_filter._probe(F.col("key"), n)).join(table, "block")
    false = probed.filter(" and ".join(f"(f{i} & w{i}) = w{i}" for i in range(4))).count()
    assert 0 < table.count() <= n and false < 0.02 * 20_000


def test_quality_is_kneser_ney(spark):
    """Against a plain reading of the formulas on a small text."""
    import numpy as np

    texts = ["The cat sat on the mat. The cat ran.", "A dog sat on a log; the dog ran off.", "the the the cat and dog"]
    grams = np.concatenate([quality.codes(t) for t in texts]).tolist()
    levels = {4: {}}
    for g in grams:
        levels[4][g] = levels[4].get(g, 0) + 1
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            low = g & ((1 << 16 * k) - 1)
            levels[k][low] = levels[k].get(low, 0) + 1
    cuts = {}
    for k, table in levels.items():
        n = [sum(c == i for c in table.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        cuts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) if n[0] and n[i - 1] and n[i] else 0.5 * min(i, 2) for i in (1, 2, 3)]
    totals = {k: {} for k in levels}
    for k, table in levels.items():
        for g, c in table.items():
            t = totals[k].setdefault(g >> 16, [0, 0.0])
            t[0] += c
            t[1] += cuts[k][min(c, 3) - 1]

    def p(g, k):
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        g &= (1 << 16 * k) - 1
        if g >> 16 not in totals[k]:
            return p(g, k - 1)
        whole, cut = totals[k][g >> 16]
        c = levels[k].get(g, 0)
        return (c - (cuts[k][min(c, 3) - 1] if c else 0)) / whole + cut / whole * p(g, k - 1)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "zebra! the cat", "", None, LONG, "\U0001f600 的"])], "doc_id long, text string")
    entries, floor = quality.model(quality.counts(docs.filter("doc_id < 3").select("text")))
    want = {r.doc_id: sum(np.log(p(g, 4)) for g in quality.codes(r.text).tolist()) for r in docs.collect() if r.doc_id != 6}
    for shard in (10**6, 25):
        got = {r.doc_id: r.l for r in quality.score(docs, entries, floor, ("doc_id",), "text", shard).groupBy("doc_id").agg(F.sum("logp").alias("l")).collect()}
        assert {k: got[k] for k in want} == pytest.approx(want)
    given = [p(g << 0, 4) for g in {(quality.codes("the cat")[3] >> np.uint64(16) << np.uint64(16)).item() | s for s in levels[1]}]
    assert 0.9 < sum(given) <= 1.0001


def test_quality_keeps_trusted_text(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.op7_quality(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[1] > 0.97 and kept[0] < 0.5


def test_thresholds_are_quantiles_by_language(spark):
    draw = random.Random(7)
    rows = [(lang, draw.randint(0, 60)) for lang, n in (("a", 400), ("b", 37), (None, 5), ("c", 1)) for _ in range(n)]
    for quantile in (0.999, 0.9, 0.5):
        own, overall = quality.thresholds(spark.createDataFrame(rows, "lang string, step long"), quantile, 50)
        least = lambda steps: min(s for s in steps if sum(x <= s for x in steps) >= quantile * len(steps))
        assert overall == least([s for _, s in rows])
        groups = {lang: [s for x, s in rows if x == lang] for lang in ("a", "b", None, "c")}
        want = {lang: (least(steps) * len(steps) + 50 * overall) / (len(steps) + 50) for lang, steps in groups.items()}
        assert {r.lang: r.own for r in own.collect()} == pytest.approx(want)
    own, overall = quality.thresholds(spark.createDataFrame([], "lang string, step long"))
    assert overall is None and own.count() == 0


def test_trusted_text_by_broadcast_or_shuffle_and_in_shards(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = lambda **options: {r.doc_id: (r.n, round(r.perplexity, 6), r.kept) for r in quality.classify(docs, labels, **options).collect()}
    assert held() == held(few_trusted=0, shard_entries=20_000)


def test_signs_beyond_the_basic_plane_are_told_apart():
    assert len({tuple(quality.codes(chr(c)).tolist()) for c in range(0x1F600, 0x1F600 + 7000, 7)}) == 1000


def test_quality_takes_awkward_rows(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 0, 0), (8, 1, None), (99, 1, 0), (None, 1, 0), (5, None, 0), (7, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (labels, none):
        rows = quality.classify(docs, table).collect()
        assert len(rows) == docs.count()
        assert all(not r.kept for r in rows if r.doc_id in (3, 4, 6))
        assert quality.classify(empty(spark), table).count() == 0
