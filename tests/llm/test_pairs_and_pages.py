"""SimHash, permutation index, decontamination, WARC and main text: small tables against brute force."""

import base64
import collections
import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from itemspark.llm import decontaminate, maintext, permutation, queries, simhash, warc

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(found[k:k + words]) for k in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """Smallest id reachable over links of at most ``radius`` bits, for (id, fingerprint) pairs."""
    label = {d: d for d, _ in prints}
    moved = True
    while moved:
        moved = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= radius and label[b] < label[a]:
                    label[a], moved = label[b], True
    return label


DOCS = ["one two three four five", "ONE  two\tthree four\nfive", None, "", " \n", "alpha", "alpha beta", "x" * 100_000, "é É è", "a b c " * 20_000, "one two three four six"]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "old", -1) for d, t in rows], "doc_id bigint, text string, fingerprint string, label int")


def test_fingerprints_and_components_against_brute_force(spark):
    rows = list(enumerate(DOCS)) + [(3, "")]
    out = simhash.components(table(spark, rows), radius=3).collect()
    assert len(out) == len(rows)
    want = brute_components([(d, brute_fingerprint(t)) for d, t in enumerate(DOCS)], 3)
    for r in out:
        assert r["fingerprint"] == f"{brute_fingerprint(DOCS[r['doc_id']]):016x}" and r["component_id"] == want[r["doc_id"]]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [2_048, 7])
def test_links_and_labels_over_clusters_and_chains(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):  # a chain whose ends are far apart
            values.add(x)
            for _ in range(rnd.choice((1, 2, 3, 3, 4))):
                x ^= 1 << rnd.randrange(64)
    centre = rnd.getrandbits(64)
    values |= {centre ^ sum(1 << b for b in rnd.sample(range(6), 2)) for _ in range(60)}
    values |= {rnd.getrandbits(64) for _ in range(200)}
    rows = list(enumerate(sorted(values, key=lambda v: xxhash.xxh64_intdigest(str(v)))))
    nodes = spark.createDataFrame([(signed(v), k) for k, v in rows], "fp bigint, node bigint")
    edges = simhash.links(nodes, 3)
    found = dict(simhash.labels(edges, str(tmp_path)).select("node", "label").collect())
    want = brute_components(rows, 3)
    assert {k: found.get(k, k) for k in want} == want


def test_tree_search_is_exact():
    rnd = random.Random(1)
    values = [rnd.getrandbits(10) for _ in range(300)]
    tree = simhash.Tree()
    for k, v in enumerate(values):
        tree.add(v, k)
    for q in values[:40]:
        assert sorted(tree.near(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_components_without_ids_and_of_nothing(spark):
    df = table(spark, [(None, "a b c d"), (7, "a b c d"), (None, "only here, far away from all"), (9, "q r s t")])
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.components(df).collect())
    assert got == {(None, 7): 1, (7, 7): 1, (None, None): 1, (9, 9): 1}
    assert simhash.components(df.where("false")).count() == 0 and simhash.deduplicated(df.where("false")).count() == 0


def test_one_document_of_each_group_stays(spark):
    df = table(spark, [(4, "a b c d"), (2, "A b c d"), (2, "A b c d"), (5, "other words stand here"), (6, None), (8, "")])
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(2, "A b c d", "old", -1), (5, "other words stand here", "old", -1), (6, None, "old", -1)]


def test_repeated_ids_lose_no_text_and_names_do_not_clash(spark):
    x, y, z = "one text that stands here for a while", "quite another text of some other words", "and a third that is like none of them"
    df = spark.createDataFrame([(2, x, 1, 1), (5, x, 2, 2), (5, y, 3, 3), (7, z, 4, 4), (7, z, 4, 4), (8, y, 5, 5), (2**62 + 1, "alone", 6, 6)], "doc_id bigint, text string, _gone int, _of int")
    df = df.withColumn("_again", F.lit(0)).withColumn("_text_hash", F.lit(0))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(2, x), (5, y), (7, z), (2**62 + 1, "alone")])
    same = spark.createDataFrame([(7, x), (7, y), (7, y), (9, y)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.deduplicated(same).collect()) == sorted([(7, x), (7, y)])


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_matches_against_dynamic_programming(spark):
    rnd = random.Random(2)
    words = "of the and then erth thon ing blest reon ande".split()
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(4, 16)))) for k in range(12)] + [(3, "  ".join(["of"] * 12)), (90, None), (91, ""), (92, "short one")]
    texts = []
    for k in range(60):
        body = list(rnd.choice(items[:12])[1])
        for _ in range(rnd.randint(0, len(body) // 7)):
            p = rnd.randrange(len(body))
            body[p] = rnd.choice(["", "x", body[p] + "y", " "])
        texts.append("Zz " * rnd.randint(0, 4) + "".join(body).upper() + "\n qq" * rnd.randint(0, 3))
    texts += [None, "", "of the " * 15_000]
    docs = table(spark, [*enumerate(texts), (0, texts[0]), (None, texts[1])])
    bench = spark.createDataFrame([(*x, "old") for x in items], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts[:61]):
        for i, item in items:
            a, b = decontaminate.folded(item), decontaminate.folded(t)
            if len(a) >= decontaminate.LEAST and (n := edits(a, b)) <= int(decontaminate.RATE * len(a)):
                want[d, i] = min(n, want.get((d, i), n))
    assert {k: v for k, v in got.items() if k[0] <= 60} == want and len(want) > 20
    kept = decontaminate.decontaminated(docs, bench)
    held = {k[0] for k in got}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == set(range(len(texts))) - held


def test_decontamination_of_nothing_and_by_nothing(spark, monkeypatch):
    docs, bench = table(spark, [(1, "a " * 40)]), spark.createDataFrame([(1, "a " * 40), (2, "b " * 40)], "item_id bigint, text string")
    assert decontaminate.matches(docs.where("false"), bench).count() == 0
    assert decontaminate.matches(docs, bench.where("false")).count() == 0 and decontaminate.decontaminated(docs, bench.where("false")).count() == 1
    monkeypatch.setattr(decontaminate, "SHIPPED", 50)  # several shards
    assert [tuple(r) for r in decontaminate.matches(docs, bench).collect()] == [(1, 1, 0)]


def brute_neighbours(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    width = collections.Counter(len(v) for _, v in ok).most_common(1)[0][0]
    ok = [(i, v) for i, v in ok if len(v) == width]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted(((float((x * v).sum()), i) for i, v in ok if i != q), key=lambda p: (-round(p[0], 12), p[1]))[:k]
    return out


def test_neighbours_with_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=8) * rng.uniform(0.2, 4)).tolist()) for k in range(150)]
    rows += [(k, rows[0][1]) for k in range(150, 210)] + [(210, [0.0] * 8), (211, None), (212, [1.0, None] + [0.0] * 6), (213, [float("nan")] * 8), (214, [float("inf")] * 8), (215, [1.0]), (None, [1.0] * 8), (216, [])]
    df = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    want, got = brute_neighbours(rows), collections.defaultdict(list)
    for r in permutation.neighbours(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys()
    for q in want:  # fewer vectors than are ranked again: nothing can be missed
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_neighbours_where_rows_repeat_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * rng.uniform(0.2, 1)).tolist()) for k in range(1, 60)]
    far, near = (5 * rng.normal(size=8)).tolist(), rng.normal(size=8).tolist()
    rows += [(60, far)] * 30 + [(61, far)] * 2 + [(62, far), (80, near), (80, near)]
    rows += [(101, rows[4][1])] * 25
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in permutation.neighbours(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_neighbours(rows)
    assert got == {q: [i for _, i in found] for q, found in want.items()} and len(got) == 4 and all(len(x) == 20 for x in got.values())
    # One id with more vectors than a result has rows, all of them ahead of the others.
    rows = [(20, [10.0 + k, 0.0]) for k in range(50)] + [(k, [1.0 / k, 1.0]) for k in range(21, 60) if k % 20]
    out = permutation.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(out) == 50 * 20 and {r["vec_id"] for r in out} == set(range(21, 42)) - {40}


def test_neighbours_of_few_and_of_nothing(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = permutation.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0])], schema)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert permutation.neighbours(spark.createDataFrame([(1, [1.0])], schema)).count() == 0 and permutation.neighbours(spark.createDataFrame([], schema)).count() == 0


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = collections.defaultdict(set)
    for r in permutation.neighbours(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]].tolist()
        hits, total = hits + len(got[ids[q]].intersection(best)), total + 20
    assert hits >= 0.95 * total


def test_archives_read_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    body = "<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é 𝒳</p>"
    rows = [(k, f"http://www.Host{k % 3}.com:80/p{k % 7}?q#f", [body, "", None, "x" * 200_000, f"page {k % 9}"][k % 5], None if k % 11 == 0 else k % 4) for k in range(80)]
    rows += [(3, "http://h.com/again", rows[3][2], 1), (None, None, "page 4", 2), (None, None, "page 4", 2), (None, "bad\r\nurl", "nowhere else", 3)]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], "page_id bigint, url string, html string, at bigint, record_type string, digest string")
    out = warc.captures(df.withColumn("captured_at", F.timestamp_seconds("at"))).collect()
    group = collections.defaultdict(list)
    for p, _, h, _ in rows:
        group[h or ""].append(p)
    want = collections.Counter()
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        last = max((x for x in group[h or ""] if x is not None), default=None)
        again = last is not None and (p is None or p < last)
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    out.sort(key=lambda r: (r["range_no"], r["place"]))
    keys = [warc.order_key(r["url_key"], r["captured_at"], r["page_id"]) for r in out]
    assert keys == sorted(keys) and len({r["range_no"] for r in out}) > 1
    assert warc.captures(df.withColumn("captured_at", F.lit(None).cast("timestamp")).where("false")).count() == 0


def test_the_warc_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rel = con.execute(queries.ORACLES["op2_warc"])
    assert [d[0] for d in rel.description] == cols
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in queries.op2_warc(spark, SF).select(cols).collect())


def test_loser_tree_merges_as_sorting_does():
    rnd = random.Random(6)
    for n in (1, 2, 3, 5, 8, 13):
        runs = [sorted(("k", "", True, rnd.randrange(9)) for _ in range(rnd.randrange(7))) for _ in range(n)]
        tree = warc.LoserTree(runs)
        assert [runs[r][k] for r, k in tree] == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTPS://user@WWW.Example.org:443/A?b=C#d") == "org,example)/a?b=c" and warc.url_key("http://x.y") == "y,x)/"
    assert warc.url_key(None) == warc.url_key("") == ""


ARTICLE = """<html><head><title>T</title><script>var a="</p>";</script><body class="has-sidebar"><header>Site</header><div class=notice>Cookies</div>
<form><input>Find<p>x</form><main><h1>A &amp; B</h1><p>One<br>two   <b>three</b>
four.<p>x &lt; y &eacute;&#x1D4B3; &amp;amp;<ul><li>i1<li>i2</ul><aside>side</aside><div id="comments"><p>nice</div><div hidden>h</div><p style="display: none">no</p><p style="overflow: hidden">2 < 3</main><div>loose</div><footer>f</footer>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, url string, html string, text string")


def test_main_text_of_marked_pages(spark):
    rows = [(1, "http://a.b/c", ARTICLE), (2, None, None), (3, "", ""), (1, "http://a.b/c", ARTICLE), (None, "u", "<article>" + "long &amp; " * 50_000 + "</article>"), (5, "v", "<article>a<!-- b --><p title='>'>c</p>")]
    out = collections.Counter(tuple(r) for r in maintext.extracted(pages(spark, rows)).collect())
    text = "A & B\nOne two three four.\nx < y é𝒳 &amp;\ni1\ni2\n2 < 3"
    long = ("long & " * 50_000).strip()
    assert out == {(1, "http://a.b/c", text, len(text)): 2, (2, None, "", 0): 1, (3, "", "", 0): 1, (None, "u", long, len(long)): 1, (5, "v", "a\nc", 3): 1}
    assert maintext.extracted(pages(spark, rows).where("false")).count() == 0


def test_shared_runs_leave_undecided_pages(spark):
    menu = "home news sport weather travel books films music and more of these"
    rows = [(k, f"http://h.com/{k}", f"<div>{menu}</div><p>own words {k} first{k} second{k}</p><div>all rights</div><nav>n</nav>") for k in range(5)]
    rows += [(9, "http://other.com/", f"<div>{menu}</div><div>all rights</div>"), (8, "http://h.com/8", f"<article><p>{menu}</p></article><footer>{menu}</footer>")]
    got = {r["page_id"]: r["text"] for r in maintext.extracted(pages(spark, rows)).collect()}
    assert got == {**{k: f"own words {k} first{k} second{k}" for k in range(5)}, 9: f"{menu}\nall rights", 8: menu}


def test_shared_runs_against_counted_windows():
    rnd = random.Random(9)
    streams = [[rnd.choice("ab") for _ in range(rnd.randint(1, 30))] for _ in range(40)]
    page = [rnd.randrange(12) for _ in streams]
    seen = collections.defaultdict(set)
    for s, p in zip(streams, page, strict=True):
        for w in [tuple(s[i:i + maintext.RUN]) for i in range(len(s) - maintext.RUN + 1)] or [("whole", *s)]:
            seen[w].add(p)
    for s, covered in zip(streams, maintext.shared_runs(streams, page), strict=True):
        want = [False] * len(s)
        for i in range(len(s) - maintext.RUN + 1):
            if len(seen[tuple(s[i:i + maintext.RUN])]) >= maintext.PAGES:
                want[i:i + maintext.RUN] = [True] * maintext.RUN
        if len(s) < maintext.RUN:
            want = [len(seen["whole", *s]) >= maintext.PAGES] * len(s)
        assert covered.tolist() == want


def test_main_elements_in_chrome_or_frames(spark):
    story = "<p>the story stands outside of any such element</p>"
    bodies = [f"{story}<aside><article>card</article></aside>", f"<div hidden><main>no</main></div>{story}", f"{story}<div class='related'><article>card</article></div>",
              "<div class='has-sidebar'><nav>n</nav><article>all of it</article></div>", "<h1>Site</h1><div class='sidebar-right'><main>a longer text</main><aside>x</aside></div>",
              "<div id='promo'><p>one page</p></div>", "<nav>only a menu</nav>", f"<article>kept</article><aside><article>card</article></aside>{story}"]
    rows = [(k, f"http://h{k}.com/", b) for k, b in enumerate(bodies)]
    outside = "the story stands outside of any such element"
    got = {r["page_id"]: r["text"] for r in maintext.extracted(pages(spark, rows)).collect()}
    assert got == dict(enumerate([outside, outside, outside, "all of it", "a longer text", "one page", "", "kept"]))


def test_parts_of_a_large_host_count_together(spark, monkeypatch):
    notice = "this page moves to another place at the end of the year"
    rows = [(k, f"http://h.com/{k}", f"<div>first{k} second{k} {notice if k % 15 == 0 else ''} third{k}</div><div>{'old page' if k % 16 == 0 else f'new {k}'}</div>") for k in range(60)]
    rows += [(100, "http://h.com/100", "<div>twice is not shared by enough pages of this host</div>")] * 2 + [(101, "http://h.com/101", rows[0][2])] * 2
    rows += [(None, "http://h.com/n", "<nav>n</nav>"), (103, "http://h.com/103", ""), (104, "http://i.com/", f"<p>{notice}</p>")]
    df = pages(spark, rows)
    whole = collections.Counter(tuple(r) for r in maintext.extracted(df).collect())
    monkeypatch.setattr(maintext, "PART", 4)
    parts = collections.Counter(tuple(r) for r in maintext.extracted(df).collect())
    assert parts == whole and (0, "http://h.com/0", "first0 second0 third0", 21) in parts and (104, "http://i.com/", notice, len(notice)) in parts


def test_main_text_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    for r in maintext.extracted(df).join(df.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1)>", inner.replace("<br>", " "))]
        assert r["text"] == "\n".join(x for x in parts if x)


def test_shared_runs_decide_within_main_elements(spark, monkeypatch):
    notice = "sign in to keep reading and get every story of this site by mail"
    card = "the one story that everybody reads on this site today"
    quote = "a passage that a few of the articles quote word by word from one source"
    story = [" ".join(f"story{k}word{n}" for n in range(20)) for k in range(3)]
    bodies = [f"<nav>menu</nav><article><h1>title{k}</h1><p>{notice}</p><p>own{k} words{k}</p>{f'<p>{quote}</p>' if k % 3 == 0 else ''}<p>end{k} {notice}</p></article><div>loose{k}</div>" for k in range(12)]
    bodies += [f"<article>{card}</article><div>{notice}</div><p>{story[k]}</p>" if k < 3 else f"<article>{card}</article><p>short{k}</p>" for k in range(20)]
    rows = [(k, f"http://h.com/{k}", b) for k, b in enumerate(bodies)] + [(k, "http://i.com/", f"<article><p>{notice}</p><p>x{k}</p></article>") for k in range(100, 107)]
    rows += [(None, "http://j.com/", f"<main><p>{notice}</p><p>y{k}</p></main>") for k in range(9)] + [(200, "http://k.com/", f"<main><p>{notice}</p><p>y{k}</p></main>") for k in range(9)]
    # Only the cards stand on most pages of h.com; i.com has too few pages, k.com one that comes nine times.
    want = {(k, f"title{k}\n{notice}\nown{k} words{k}{f'{chr(10)}{quote}' if k % 3 == 0 else ''}\nend{k} {notice}"): 1 for k in range(12)}
    want |= {(12 + k, story[k] if k < 3 else card): 1 for k in range(20)}
    want |= {(k, f"{notice}\nx{k}"): 1 for k in range(100, 107)} | {(None, f"y{k}"): 1 for k in range(9)} | {(200, f"{notice}\ny{k}"): 1 for k in range(9)}
    whole = collections.Counter((r["page_id"], r["text"]) for r in maintext.extracted(pages(spark, rows)).collect())
    assert whole == want
    # With a page less of the cards and the notice on six more, the notice is what most pages hold.
    more = [(k, u, f"<article><p>{notice}</p>{b}</article>" if k in range(14, 26) else b) for k, u, b in rows if u != "http://h.com/31"]
    found = collections.Counter((r["page_id"], r["text"]) for r in maintext.extracted(pages(spark, more)).collect())
    assert found[0, f"title0\nown0 words0\n{quote}\nend0 {notice}"] == found[1, f"title1\nown1 words1\nend1 {notice}"] == 1
    for part in (2, 7):
        monkeypatch.setattr(maintext, "PART", part)
        assert collections.Counter((r["page_id"], r["text"]) for r in maintext.extracted(pages(spark, rows)).collect()) == whole
        assert collections.Counter((r["page_id"], r["text"]) for r in maintext.extracted(pages(spark, more)).collect()) == found
