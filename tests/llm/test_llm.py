"""The corpus operators against brute force, round trips and held-out accuracy, and on hard cases."""

import hashlib
import pathlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import binary_output, decontaminate, html_text, language, line_dedup, linking, near_dup, packing, quality, queries, sharding, suffix_dedup
from quillon.llm.tokens import PIECES, UNSAFE, WordEncoder, default_tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, one long text.
HARD = [
    (None, None, None, None, None), (None, "a line of its own, here", "en", None, 3), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, " \n \t\n", None, "s", 5), (3, "word", "en", "s", 4), (3, "other", "de", "s", 5),
    (4, "the same words again and again\n" * 3, "en", "t", 9), (4, "the same words again and again\n" * 3, "en", "t", 9), (5, "x" * 50_000, "en", "t", 1), (6, "ein kurzer Text mit ein paar Wörtern — und Zeichen 1234 !?", "de", "t", 1), (7, "日本語のテキストです。" * 30, "ja", "t", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def hard(spark, clash=True):
    df = spark.createDataFrame(HARD, DOCS)
    if clash:
        for name in ("size", "shard", "slot", "score", "lang_pred", "kept", "contaminated", "gone", "line", "id", "bucket", "key", "n", "LAW", "distance"):
            df = df.withColumn(name, F.lit("theirs"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# --- tokens ----------------------------------------------------------------------------------------------------------------------


def test_tokens_are_the_tokenizers(texts):
    own = WordEncoder(default_tokenizer(), most=500)
    odd = ["", None, "It's  we'll 'S x's!!'s <|startoftext|> a", "ſtraße İI Σας ÀÉ á", "10% of 3.5² _foo__ b_c '' 'tis", "\x1c a\x85b c", "日本語 🙂!!", "a\tb\nc\r\n d'll've", "÷×ǅ ǆ"]
    for t in odd + [t for _, t in texts]:
        assert own.ids(t) == np.array(own.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert UNSAFE.search("İ") and not UNSAFE.search("é") and PIECES.findall("it's_5") == ["it", "'s", "_", "5"]


# --- 1 ---------------------------------------------------------------------------------------------------------------------------


def check_shards(rows, most):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(r.size for r in own) for own in by.values()]
    return max(sizes) - min(sizes) <= 4 * most if len(by) == 8 else True


def test_resharding(spark):
    rows = queries.op1_resharding(spark, SF).collect()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(source) and all(r.size == len(source[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(source[r.doc_id].encode()) for r in rows)
    assert check_shards(rows, max(r.size for r in rows)) and {r.law for r in rows} == {"bytes"}


def test_flow_is_optimal_and_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(40):
        n, m = rng.randint(1, 5), rng.randint(1, 4)
        sizes = {i: rng.randint(0, 9) for i in range(n)}
        capacity = sharding.near_equal(sum(sizes.values()), m)
        cost = {(i, j): rng.randint(0, 5) for i in sizes for j in range(m)}
        flows = sharding.min_cost_flow(sizes, capacity, cost)
        assert all(sum(f for i, _, f in flows if i == k) == s for k, s in sizes.items()) and all(sum(f for _, j, f in flows if j == k) == c for k, c in enumerate(capacity))
        # byte by byte dynamic program over the supplies
        best = {tuple(capacity): 0}
        for i, s in sizes.items():
            for _ in range(s):
                new = {}
                for room, c in best.items():
                    for j in range(m):
                        if room[j]:
                            r = (*room[:j], room[j] - 1, *room[j + 1 :])
                            new[r] = min(new.get(r, 10**9), c + cost[i, j])
                best = new
        assert sum(f * cost[i, j] for i, j, f in flows) == min(best.values())
    sizes = {0: 100, 1: 10, 2: 10}
    flows, at = sharding.plan_moves(sizes, 2)
    assert sum(f for i, j, f in flows if at[j] != i) == 120 - 60 - 10


def test_resharding_hard_and_rewrite(spark, tmp_path):
    done = sharding.reshard(hard(spark), F.pmod(F.xxhash64("source"), F.lit(4)), shards=3, block_rows=2)
    rows = done.collect()
    assert len(rows) == len(HARD) and check_shards(rows, 50_001) and {"lang", "line"} <= set(done.columns) and {r.size for r in rows if r.text is None} == {1}
    written = sharding.rewrite_affected(done, str(tmp_path / "shards"))
    assert sum(spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().where(F.col("shard") == s).first()["count"] for s in written) == sum(r.shard in written for r in rows)
    assert sharding.reshard(empty(spark), F.lit(0)).count() == 0


def test_resharding_rewrites_files(spark, docs):
    from quillon.session import shared_dir

    written = lambda: {p for p in pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("shards-*")}
    before = written()
    rows = queries.op1_resharding(spark, SF).collect()
    (path,) = written() - before
    got = spark.read.parquet(str(path))
    at = {r.doc_id: (r.shard, r.slot) for r in rows}
    texts = {r.doc_id: tuple(r) for r in docs.collect()}
    own = got.collect()
    assert set(docs.columns) <= set(got.columns) and all(tuple(r[c] for c in docs.columns) == texts[r.doc_id] and at[r.doc_id] == (r.shard, r.slot) for r in own)
    affected = {r.shard for r in own}
    assert sorted(r.doc_id for r in own) == sorted(r.doc_id for r in rows if r.shard in affected) and affected >= {r.shard for r in rows if r.moved}


# --- 2 ---------------------------------------------------------------------------------------------------------------------------


def check_packed(rows, source, capacity, end):
    own = WordEncoder(default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in source:
        ids = own.ids(t) + np.array([end], "<u4").tobytes()
        cuts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in cuts] == list(range(0, len(ids) // 4, capacity)) and all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in cuts) and sum(r.length for r in cuts) == len(ids) // 4
    for own_ in by_sequence.values():
        at = 0
        for r in sorted(own_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, texts):
    rows = queries.op2_packing(spark, SF).collect()
    n, least = check_packed(rows, texts, 2048, 0), -(-sum(r.length for r in rows) // 2048)
    assert n <= least * 1.02 + 1


def test_packing_plans_are_near_the_bound_and_whole():
    rng = random.Random(1)
    for _ in range(5):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(20)}
        plan = packing.solve(counts, 64)
        held = defaultdict(int)
        for config, times in plan.configs:
            assert sum(length * k for length, k in config) <= 64
            for length, k in config:
                held[length] += k * times
        total = sum(t for _, t in plan.configs)
        assert held == counts and plan.bound <= total <= 1.1 * sum(k * v for k, v in counts.items()) / 64 + 5 + sum(v for k, v in counts.items() if k > 40)
    assert packing.knapsack(np.array([0, 0, 0, 5.0, 0, 7.0, 0, 0, 0]), 8)[8] == 12.0


def least_sequences(items, capacity):
    """The fewest sequences, by trying every way to place the longest item left."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for chosen in range(1 << len(rest)):
        own = [x for k, x in enumerate(rest) if chosen >> k & 1]
        if first + sum(own) <= capacity:
            best = min(best, 1 + least_sequences([x for k, x in enumerate(rest) if not chosen >> k & 1], capacity))
    return best


def test_packing_bound_holds_against_brute_force():
    rng = random.Random(6)
    for _ in range(25):
        items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        plan = packing.solve({x: items.count(x) for x in items}, 20)
        least, total = least_sequences(items, 20), sum(t for _, t in plan.configs)
        assert plan.bound <= least <= total <= least + 1, (items, plan)
    assert packing.solve({11: 100}, 20).bound == 100 and packing.solve({}, 20).configs == []


def test_the_program_covers_everything_and_beats_best_fit():
    rng = random.Random(7)
    hard_for_best_fit = {510: 600, 270: 600, 260: 600, 230: 1200}  # 900 sequences will do
    for counts in (hard_for_best_fit, {rng.randint(1, 999): rng.randint(1, 10**6) for _ in range(60)}, {rng.randint(1, 400): 1 for _ in range(30)}):
        need = np.zeros(1001)
        need[list(counts)] = list(counts.values())
        program = packing.configuration_program(need, 1000)
        held = np.zeros(1001)
        for config, amount in program.used.items():
            assert sum(length * n for length, n in config) <= 1000
            for length, n in config:
                held[length] += amount * n
        assert np.allclose(held, need, rtol=1e-6) and np.allclose(program.cover, need, rtol=1e-6) and 0 <= program.excess < 0.25
    plan = packing.solve(hard_for_best_fit, 1000)
    total = sum(t for _, t in plan.configs)
    best_fit = sum(t for _, t in packing.best_fit_decreasing(np.bincount(list(hard_for_best_fit), weights=list(hard_for_best_fit.values()), minlength=1001).astype(int), 1000))
    assert best_fit == 1100 and 900 <= total < 1000 and plan.placed > 0.9 * total


def test_the_program_places_most_sequences(spark):
    own, counts = WordEncoder(default_tokenizer()), defaultdict(int)
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toLocalIterator():
        n = len(own.ids(r.text)) // 4 + 1
        counts[2048] += n // 2048
        counts[n % 2048] += n % 2048 > 0
    counts = {k: v for k, v in counts.items() if v}
    plan = packing.solve(counts, 2048)
    total, full = sum(t for _, t in plan.configs), counts.get(2048, 0)
    assert plan.placed - full > 0.5 * (total - full) and plan.bound <= total <= plan.bound * 1.001 + 1


def test_packing_hard(spark):
    rows = packing.pack(hard(spark), default_tokenizer(), capacity=50, bucket_rows=3).collect()
    assert sum(r.doc_id is None for r in rows) >= 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(empty(spark), default_tokenizer()).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------------------


def test_quality_equals_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r for r in con.execute(quality.oracle()).fetchall()}
    names = [c[0] for c in con.description]
    got = quality.quality(docs).collect()
    assert len(got) == len(want) and all(tuple(r[c] for c in names) == want[r.doc_id] for r in got)


def test_quality_hard(spark):
    rows = {(r.doc_id, r.n_words): r for r in quality.quality(hard(spark)).collect()}
    assert rows[4, 18].n_dup_lines == 2 and rows[4, 18].n_repeat_words == 18 and rows[None, 0].base_failed and not rows[2, 0].kept and rows[5, 1].word_chars == 50_000
    assert quality.quality(empty(spark)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------------------


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(k, 40))) for k in (1, 0))
        assert decontaminate.distance_within(decontaminate.masks_of(p), len(p), t) == edits(p, t)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 18)))) for i in range(12)] + [(50, None), (51, " "), (None, "only by null id this one here"), (52, "tiny")]
    rows = []
    for i in range(80):
        body = [word() for _ in range(20)]
        if i % 2:
            planted = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 6)):
                planted[rng.randrange(len(planted))] = rng.choice("abz")
            body.insert(rng.randrange(20), "".join(planted).upper())
        rows.append((i, "  ".join(body)))
    rows += [(100, None), (101, ""), (102, "see ONLY by\nnull id this one here")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("distance", F.lit("x")), spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 60):  # one block, and several
        got = {r.doc_id: r for r in decontaminate.contamination(df, bench, piece_chars=8, block_chars=size).collect()}
        for i, t in rows:
            want = sorted((n for n, b in items if (c := decontaminate.normal(b)) and edits(c, decontaminate.normal(t)) <= max(0, len(c) // 8 - 1)), key=lambda n: (n is not None, n))
            assert got[i].item_ids == want and got[i].contaminated == bool(want), (i, t)


def test_windows_of_a_repetitive_text_are_one():
    assert decontaminate.windows({0, 5, 300, 40}, 20, 3) == [(0, 28), (37, 63), (297, 323)] and decontaminate.windows(set(), 5, 1) == []
    item = "ab" * 400
    text = "x" + "ab" * 30_000 + "y"
    matcher = decontaminate.Matcher([(1, "ab" * 200 + "c" + "ab" * 199, 24), (2, item, 24)])
    began = time.process_time()
    assert matcher.find(text) == {0: 1, 1: 0}
    assert time.process_time() - began < 10


def test_decontamination_hard(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(hard(spark), bench).count() == len(HARD) and decontaminate.contamination(hard(spark), bench.where("false")).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(hard(spark), bench)
    assert kept.count() == len(HARD) and kept.columns == hard(spark).columns and decontaminate.drop_contaminated(empty(spark), bench).count() == 0
    exact = {i for i, t in [(r.doc_id, r.text) for r in docs.collect()] if any(b.text in t for b in bench.collect())}
    assert exact <= {r.doc_id for r in queries.op4_decontamination(spark, SF).where("contaminated").collect()}


# --- 5 ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[5], [0, 0, 0, 5], [1, 1, 7, 7], sorted(random.Random(1).choices(range(100_000), k=1000)), list(range(500))])
def test_elias_fano(values):
    ef = binary_output.EliasFano.encode(np.array(values), max(values))
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    assert len(values) < 500 or 8 * (len(ef.low) + len(ef.high)) <= len(values) * (3 + np.log2(max(2, max(values) / len(values))))


def test_token_output_round_trip(spark, texts, tmp_path):
    own, path = WordEncoder(default_tokenizer()), str(tmp_path / "ids")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    binary_output.write_tokens(docs, path, default_tokenizer(), block_ids=3000)
    got, at = sorted(binary_output.read_documents(spark, path).collect(), key=lambda r: r.doc_id), 0
    for r, (i, t) in zip(got, sorted(texts), strict=True):
        ids = own.ids(t) + np.array([1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_output_of_far_apart_ids(spark):
    ids = [None, None, -(1 << 63), -(1 << 63), -7, 0, 5, 5, 1 << 40, (1 << 63) - 1]
    rows = binary_output.token_output(spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string"), default_tokenizer()).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == ids


def test_token_output_hard(spark):
    rows = sorted(binary_output.token_output(hard(spark), default_tokenizer()).collect(), key=lambda r: r.start)
    assert len(rows) == len(HARD) and [r.doc_id for r in rows] == sorted((r[0] for r in HARD), key=lambda i: (i is not None, i or 0)) and rows[0].n_tokens == 1
    assert binary_output.token_output(empty(spark), default_tokenizer()).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------------------

ODD_PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><div class="cookie-notice">We use cookies</div><nav><p>Menu words here</p></nav>
<main><article><header><h1>Title &amp; more</h1><p>By someone</p></header><p>First   part<br>goes on.</p><script>var x="</p>";</script><ul><li>One</li><li>Two</li></ul><div class="ad">Buy!</div><p>Caf&eacute; &#8212; end</p>
<section id="comments"><p>Nice article!</p></section></article><aside>Side</aside></main><form><p>Sign up</p></form><footer>Foot</footer></body>"""


def test_html(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = {r[0]: r[2] for r in con.execute(html_text.ORACLE).fetchall()}
    got = {r.page_id: r for r in queries.op6_html_extraction(spark, SF).collect()}
    assert len(got) == len(want) and all(got[i].text == t and got[i].n_chars == len(t) for i, t in want.items())
    assert html_text.main_text(ODD_PAGE) == "Title & more\n\nFirst part goes on.\n\nOne\n\nTwo\n\nCafé — end"
    long = "A paragraph of plain words that is long enough to be the text of a page, without any element that says so."
    assert html_text.main_text(f"<div><a href=x>Home</a></div><div class=menu><p>m</p></div><p>{long}</p><p>Short.</p><div id='footer'>f</div>") == f"{long}\n\nShort."
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>" * 5000), (2, "u", "no markup")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "", "", "no markup"] and html_text.extract(pages.where("false")).count() == 0


def test_html_surges_and_dives_decide():
    """Pages whose markup says nothing of boilerplate."""
    links = "".join(f"<li><a href='{k}'>Another story number {k} of the day</a></li>" for k in range(5))
    first, last = "The first paragraph tells what happened in some plain words.", "The last one says how it ended."
    article = f"<article><ul>{links}</ul><p>{first}</p><p><a href=s>The source of it all</a></p><p>{last}</p><ul>{links}</ul></article>"
    want = f"{first}\n\nThe source of it all\n\n{last}"
    assert html_text.main_text(article) == want
    # with a window of one line the single line of links goes, with one as long as the page no list does
    assert html_text.main_text(article, window=1) == f"{first}\n\n{last}"
    inner = f"<article><p>{first}</p><ul>{links}</ul><p>{last}</p></article>"
    assert html_text.main_text(inner) == f"{first}\n\n{last}" and "number 3" in html_text.main_text(inner, window=50)
    body = f"<body><div>Site</div><ul>{links}</ul><h1>A title</h1><p>{first}</p><p>{last}</p><ul>{links}</ul><div>All rights kept</div></body>"
    assert html_text.main_text(body) == f"A title\n\n{first}\n\n{last}"
    assert html_text.main_text("<h1>Title</h1><p>Short.</p>") == "Title\n\nShort." and html_text.main_text("<head><title>T</title><body><p>Text.</p>") == "Text."
    assert html_text.stretches([0, 5, 0, 0, 7, 0, 0, 0, 2], 3) == [(1, 5, 7), (8, 9, 2)]


# --- 7 ---------------------------------------------------------------------------------------------------------------------------


def near_classes(texts, threshold=0.8):
    cells, sets, owners = [near_dup.cells(t) for _, t in texts], Sets(), defaultdict(list)
    for i, c in enumerate(cells):
        for v in c.tolist():
            owners[v].append(i)
    for own in owners.values():
        for b in own[1:]:
            both = len(np.intersect1d(cells[own[0]], cells[b]))
            if both >= threshold * (len(cells[own[0]]) + len(cells[b]) - both):
                sets.join(own[0], b)
    pairs = {(a, b) for own in owners.values() if len(own) < 40 for b in own for a in own if a < b}
    for a, b in pairs:
        both = len(np.intersect1d(cells[a], cells[b]))
        if both >= threshold * (len(cells[a]) + len(cells[b]) - both):
            sets.join(a, b)
    seen = {}
    for i, (_, t) in enumerate(texts):
        if t is not None:
            sets.join(seen.setdefault(t, i), i)
    return [sets.find(i) for i in range(len(texts))]


def test_darts_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        other = np.concatenate([base[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share)).astype(np.uint64)])
        a, b = near_dup.dart_signatures([base, other], 2000)
        true = share / (2 - share)
        assert abs((a == b).mean() - true) < 0.05
    few = near_dup.dart_signatures([base[:1], base[:2]], 50)
    assert (few != 0).all() and (near_dup.dart_signatures([base], 64) == near_dup.dart_signatures([base[::-1].copy(), base[:3]], 64)[:1]).all()


def test_weights_count():
    one, twice = near_dup.cells("a b c d e"), near_dup.cells("a b c d e a b c d e")
    assert len(one) == 1 and len(twice) == 6 and len(near_dup.cells("x y")) == 1 and len(near_dup.cells(" \n")) == 0 and (near_dup.cells("A  b\nc d e") == one).all()


def test_near_duplicates_against_brute_force(spark, texts):
    rng, rows = random.Random(2), list(texts)
    for k, (_, t) in enumerate(texts[:60]):
        words = t.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        rows += [(10_000 + k, " ".join(words)), (20_000 + k, t)]
    want = near_classes(rows)
    got = {r.doc_id: r for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for (i, _), c in zip(rows, want, strict=True):
        least[c] = min(least.get(c, i), i)
    assert {i: got[i].class_id for i, _ in rows} == {i: least[c] for (i, _), c in zip(rows, want, strict=True)}
    assert sum(r.kept for r in got.values()) == len(least) and all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_near_duplicate_recall_by_similarity(spark):
    """Pairs with edits spread over their words: how many of those at the threshold or above are linked, and none below it is."""
    rng, rows, pairs = random.Random(12), [], []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for k in range(400):
        words = [word() for _ in range(300)]
        other = list(words)
        for _ in range(rng.randint(1, 8)):
            other[rng.randrange(300)] = word()
        a, b = near_dup.cells(" ".join(words)), near_dup.cells(" ".join(other))
        both = len(np.intersect1d(a, b))
        pairs.append((2 * k, both / (len(a) + len(b) - both)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i: got[i] == got[i + 1] for i, _ in pairs}
    for low, high, least in ((0.8, 0.85, 0.99), (0.85, 0.9, 0.99), (0.9, 1.01, 1.0)):
        own = [linked[i] for i, j in pairs if low <= j < high]
        assert len(own) > 20 and sum(own) >= least * len(own), (low, sum(own), len(own))
    below = [linked[i] for i, j in pairs if j < 0.8]
    assert len(below) > 20 and not any(below)


def test_strays_meet_in_finer_buckets(spark):
    """Many documents share a passage, so a band, and no more: the pairs among them that are near are found, and few others are compared."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage, rows = [word() for _ in range(120)], []
    for k in range(150):
        own = [word() for _ in range(60)]
        rows.append((10 * k, " ".join(passage + own)))
        if k % 10 == 0:
            rows.append((10 * k + 1, " ".join(passage + own[:-2] + [word()])))
    want = near_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for (i, _), c in zip(rows, want, strict=True):
        least[c] = min(least.get(c, i), i)
    assert got == {i: least[c] for (i, _), c in zip(rows, want, strict=True)}


def test_workers_keep_little(spark):
    near_dup.powers(3 << 20)
    assert not near_dup._powers or len(near_dup._powers[0]) <= (1 << 21) + 1
    text = "word " * 300_000 + "x" * 2_000_000
    assert (near_dup.word_hashes(text) == near_dup.word_hashes(text, chunk=1 << 30)).all()
    one, two = [(1, "some item", 0)], [(2, "another", 0)]
    decontaminate.matcher("a", "x", one), decontaminate.matcher("a", "y", two)
    assert len(decontaminate._matchers) == 2 and decontaminate.matcher("b", "x", two).items == two and len(decontaminate._matchers) == 1
    own = WordEncoder(default_tokenizer(), most=50)
    for k in range(40):
        own.ids(" ".join(f"w{k}{j}" for j in range(20)) + " " + "y" * 100)
    assert len(own.tokens) + len(own.older_tokens) <= 150 and "y" * 100 not in own.tokens


def test_near_duplicates_hard(spark):
    rows = near_dup.classes(hard(spark)).collect()
    assert len(rows) == len(HARD) and sum(r.kept for r in rows) == len(HARD) - 2
    kept = near_dup.drop_near_duplicates(hard(spark))
    assert kept.columns == hard(spark).columns and kept.count() == len(HARD) - 2 and near_dup.classes(empty(spark)).count() == 0


def test_bitmaps(spark):
    keys, all_ = spark.range(500).selectExpr("id * 7919 - 900000 as k"), spark.range(2000).selectExpr("id * 7919 - 900000 as k").union(spark.sql("select cast(null as bigint)"))
    bits = linking.bitmap(keys, "k")
    inside, outside = linking.maybe_in(all_, "k", bits), linking.not_in(all_, "k", bits)
    assert inside.count() >= 500 and inside.join(keys, "k", "left_semi").count() == 500 and inside.count() + outside.count() == 2001


def test_links_of_strays_are_found(spark):
    """One bucket: a large component and strays that only non-pivots are linked with."""
    linked = {(10, 11), (11, 12), (12, 13), (20, 21), (21, 10)} | {(30, k) for k in range(31, 45)}
    ids = [10, 11, 12, 13, 20, 21, *range(30, 45), 60, 61]
    members = spark.createDataFrame([(i, [1]) for i in ids], "id long, buckets array<long>")
    edges = spark.createDataFrame([(min(p), max(p)) for p in linked], "a long, b long")

    def prepare(_):
        return (lambda rows, others, last: rows.join(others, "bucket").where("comp <> x_comp").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct().join(edges, ["a", "b"], "left_semi")), None

    for pivots in (1, 8):
        got = {r.node: r.comp for r in linking.link(members, prepare, pivots=pivots).collect()}
        assert {k: got.get(k, k) for k in ids} == {k: 10 if k < 30 else 30 if k < 45 else k for k in ids}


# --- 8 ---------------------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_hard(spark):
    df = hard(spark)
    model = language.fit(df)
    rows = language.predict(df, model).collect()
    assert len(rows) == len(HARD) and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows) and all(r.line == "theirs" for r in rows)
    assert {r.lang_pred for r in language.predict(df, language.fit(empty(spark))).collect()} == {"und"} and language.predict(empty(spark), model).count() == 0
    far = language.predict(spark.createDataFrame([(1, "ωψχφ υτσρ πο")], "doc_id long, text string"), language.fit(df.where("doc_id = 6")), max_distance=0.97)
    assert far.first().lang_pred == "und"


def test_language_limit_rejects_unlearned_scripts(spark):
    """Texts of unlearned scripts go whatever their length; known documents stay, and so do their first five words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = language.fit(docs.where(language.fold(F.col("doc_id")) != 0)), random.Random(1)
    word = lambda first, last: "".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 9)))
    scripts = {"greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "han": (0x4E00, 0x9FA5), "arabic": (0x627, 0x64A)}
    for first, last in scripts.values():
        for n in (5, 20, 100, 1000):
            text = " ".join(word(first, last) for _ in range(n))
            assert all(model.judge(text, model.limit)[0] == "und" for _ in range(3))
    texts = [r.text for r in docs.select("text").collect()]
    assert all(model.judge(t, model.limit)[0] != "und" for t in texts)
    assert sum(model.judge(" ".join(t.split()[:5]), model.limit)[0] == "und" for t in texts) <= 0.01 * len(texts)
    long = " ".join(texts[:200])
    whole, parts = language.slots(long), np.concatenate([language.slots(c) for c in language.chunks(long)])
    assert len(long) > language.CHUNK and (np.sort(whole) == np.sort(parts)).all()
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs.withColumn("lang", F.col("doc_id").cast("string")), per_language=1, max_languages=20)


def test_language_keeps_columns_of_the_callers(spark):
    df = hard(spark)
    out = corpus_pipeline.identify_language(spark, df, SF)
    assert out.columns == df.columns and {(r.score, r.lang_pred) for r in out.collect()} == {("theirs", "theirs")}


# --- 9 ---------------------------------------------------------------------------------------------------------------------------


def removed_by_brute_force(rows, width=12, threshold=0.8):
    """(doc, place) of the lines to remove, of rows (doc_id, text) with different ids: by the shingles at every character."""
    places = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", line)]
    sets, owners = Sets(), defaultdict(set)
    own = {line: {line[i : i + width] for i in range(max(1, len(line) - width + 1))} for line in {p[2] for p in places}}
    for line, found in own.items():
        for s in found:
            owners[s].add(line)
    for a, b in {(a, b) for o in owners.values() for a in o for b in o if a < b and min(len(own[a]), len(own[b])) >= threshold * max(len(own[a]), len(own[b]))}:
        both = len(own[a] & own[b])
        if both >= threshold * (len(own[a]) + len(own[b]) - both):
            sets.join(a, b)
    first = {}
    for i, k, line in sorted(places, key=lambda p: p[:2]):
        first.setdefault(sets.find(line), (i, k))
    return {(i, k) for i, k, line in places if first[sets.find(line)] != (i, k)}


def test_lines_against_brute_force(spark, texts):
    rng, rows = random.Random(4), list(texts[:120])
    for k, (_, t) in enumerate(texts[:40]):
        lines = t.split("\n")
        words = lines[0].split(" ")
        words[-1] = "Changed."
        rows.append((5000 + k, "\n".join([" ".join(words), "", *rng.sample(lines, len(lines) // 2)])))
    gone = removed_by_brute_force(rows)
    want = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert all(got[i].text == (t if t.strip() else "") for i, t in want.items()) and sum(r.n_removed for r in got.values()) == len(gone)


def removed_by_stage(spark, rows):
    found = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    keys = {r.k: r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    return {(keys[r._lm_doc], k) for r in found for k in r.gone}


def test_lines_that_are_alike_at_word_starts_only_stay(spark):
    """Different lines with equal shingles at the words, and a pair that every-character shingles link."""
    lines = [
        "https://example.com/a/one", "https://example.com/z/two/three", "Total amount due: 15", "Total amount due: 99", "1001,2024-01-01,alpha,3.50", "1001,2024-01-0x,omega,7.25,and,much,more",
        "aGVsbG8gd29ybGQgYWxsIHRoZSB3YXk=", "aGVsbG8gd29yeHh4eHh4eHh4eHh4eHg=", "日本語の mostly ascii text follows here one", "日本語の mostly ascii text follows here, another end of it",
        "section number 1", "section number 2", "https://example.org/one", "https://example.org/two-different", "INTERNATIONALIZATION-A 7", "INTERNATIONALIZATION-B 9", "Total price 10", "Total price 99",
    ]
    rows = list(enumerate(lines))
    assert removed_by_brute_force(rows) == set() == removed_by_stage(spark, rows)


def test_lines_against_every_character_shingles(spark, texts):
    rng, rows = random.Random(14), list(texts[:120])
    for k, (_, t) in enumerate(texts[:40]):
        line = t.split("\n")[0]
        at = rng.randrange(max(1, len(line)))
        rows.append((6000 + k, line[:at] + "Z" + line[at + 1 :]))
    assert removed_by_stage(spark, rows) == removed_by_brute_force(rows)


def test_lines_that_differ_at_word_starts_are_linked(spark):
    """Long words, lines without spaces and ends of lines: alike at most characters, at few word starts."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for k in range(60):
        long = word(150)
        rows += [(10 * k, long), (10 * k + 1, "Q" + long[1:])]
        last = word(90)
        rows += [(10 * k + 2, f"x y {last}"), (10 * k + 3, f"u v {last}")]
    want = removed_by_brute_force(rows)
    assert len(want) == 120 and removed_by_stage(spark, rows) == want


@pytest.mark.parametrize("crowd", [0, 100])
def test_crowded_lines_keep_their_links(spark, monkeypatch, crowd):
    """A crowd of near copies, links among its strays, and links of crowded lines with lines outside the crowd."""
    rng = random.Random(21)
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base, lines = [word() for _ in range(60)], []
    for _ in range(140):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(60)] = word()
        lines.append(" ".join(own))
        if rng.random() < 0.2:
            own[rng.randrange(60)] = word()
            lines.append(" ".join(own))
    for k in range(20):
        tail = [word() for _ in range(40)]
        lines += [" ".join(base[:20] + tail), " ".join(base[:20] + tail[:-1] + [word()]), " ".join(tail[:-2] + base[:18])]
    rows = list(enumerate(dict.fromkeys(lines)))
    want, got = removed_by_brute_force(rows), removed_by_stage(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_lines_of_few_shingles_that_repeat(spark):
    """Lines of one repeated shingle have the same set, however long they are."""
    rows = [(1, "-" * 80 + "\nfirst of its kind"), (2, "-" * 100), (3, "ab" * 40), (4, "ab" * 55), (5, "something else altogether")]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_lines_hard(spark):
    out = line_dedup.dedup_lines(hard(spark), counts=True)
    rows = out.collect()
    assert len(rows) == len(HARD) and out.columns == [*hard(spark).columns, "n_lines", "n_removed"]
    assert {r.text for r in rows if r.doc_id == 4} == {"the same words again and again\n"} and [r.text for r in rows if r.lang is None and r.doc_id is None] == [None] and {r.text for r in rows if r.doc_id == 2} == {" \n \t\n"}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_run_no_python(spark, docs):
    plan = line_dedup.dedup_lines(docs, counts=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 10 --------------------------------------------------------------------------------------------------------------------------


def repeats_by_brute_force(rows, length):
    seen, data = defaultdict(int), [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = defaultdict(list)
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i].append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [2000, 7])
def test_repeats_against_brute_force(spark, monkeypatch, chunk):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("ab cdé"), n))
    shared = [text(30) for _ in range(5)]
    rows = [(i, "".join(text(int(rng.integers(0, 25))) + shared[int(rng.integers(0, 5))][int(rng.integers(0, 8)) :] for _ in range(int(rng.integers(0, 4))))) for i in range(100)]
    rows += [(200, "aaaa" * 20), (201, "abcabc" * 9), (202, None), (203, ""), (204, rows[3][1]), (204, rows[3][1]), (None, rows[5][1]), (206, "x" * 19), (207, "x" * 20), (208, "y" * 21)]
    spans = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n, g: spans(d, n, g, chunk))
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)), 20, 6).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = repeats_by_brute_force(rows, 20)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_suffixes_sort_as_bytes_do():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    start = np.sort(rng.integers(0, 390, 120))
    end = np.minimum(start + 30, 400)
    group = np.sort(rng.integers(0, 4, 120))
    order = suffix_dedup.Suffixes(data, start, end).sort(group)
    key = lambda i: bytes(data[start[i] : end[i]])
    assert [key(i) for i in order] == [key(i) for g in range(4) for i in sorted(np.flatnonzero(group == g), key=key)] and (group[order] == group).all()


def test_repeats_hard(spark):
    rows = suffix_dedup.remove_repeats(hard(spark)).collect()
    assert len(rows) == len(HARD) and {r.n_removed for r in rows if r.doc_id == 5} == {50_000} and suffix_dedup.remove_repeats(empty(spark)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(path := str(tmp_path / str(k)))
        after = spark.read.parquet(path)
        rows, own = {r.doc_id: r.text for r in before.collect()}, after.collect() if k < 4 else None
        if k < 4:
            assert after.columns == docs.columns
            kept = {r.doc_id: r.text for r in own}
            counts.append(len(kept))
        if k == 0:
            assert kept == rows
        if k == 1:
            gone = removed_by_brute_force(sorted(rows.items()))
            want = {i: "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows.items()}
            assert kept == {i: t for i, t in want.items() if t.strip()} and all(r.n_chars == len(r.text) for r in own)
        if k == 2:
            texts = sorted(rows.items())
            first = {}
            for (i, _), c in zip(texts, near_classes(texts), strict=True):
                first.setdefault(c, i)
            assert set(kept) == set(first.values())
        if k == 3:
            assert all(not any(b in decontaminate.normal(t) for b in bench) for t in kept.values()) and len(rows) - len(kept) <= 40
        if k == 4:
            assert check_packed(after.collect(), sorted(rows.items()), 2048, 0) > 0
        before = after
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_hard(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    for df in (hard(spark), empty(spark)):
        assert stage(spark, df, SF).count() <= max(2000, df.count())
