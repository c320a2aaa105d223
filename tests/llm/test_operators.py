"""Small cases against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callsight.llm import bpe, chat, line_templates, near_duplicates, neighbours, packing, quality, rules, url_lists, wrappers

SCHEMA = "doc_id long, text string, n_words string, kept long, __x int"
LONG = " ".join(f"word{at % 977} and" for at in range(6000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "a b c d a b c\na b c d a b c"),
    (7, LONG), (8, LONG + " end"), (8, LONG + " end"), (None, "nobody's text <|endoftext|> \x1c\x85 é 👩‍👩‍👧"), (None, None),
    (9, "x" * 5000), (10, "#*$%&|<> " * 30), (11, LONG),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "n", 5, 1) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rules_count_like_brute_force(documents, nothing):
    def brute(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often, covered = Counter(windows), set()
        for at, window in enumerate(windows):
            if often[window] > 1:
                covered |= {at, at + 1, at + 2}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    found = rules.ledger(rules.measured(documents))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((row.text, tuple(row[n] for n in names)) for row in found.collect())
    assert got == Counter((text, brute(text)) for _, text in TEXTS)
    kept = rules.applied(found, rules.CURRENT, into="verdict").where("verdict").count()
    cost = {row.rule: row for row in rules.ablation(found, rules.CURRENT).collect()}
    without = rules.Policy("x", tuple(n for n in rules.CURRENT.rules if n != "few_words"))
    assert cost["few_words"].n_kept_without == rules.applied(found, without, into="verdict").where("verdict").count()
    assert cost["few_words"].n_kept_without - cost["few_words"].n_failed_alone == kept
    assert rules.stage(documents.sparkSession, nothing, "").columns == documents.columns
    assert rules.ledger(rules.measured(nothing)).count() == 0


def test_packing_is_exact_gapless_and_tight(documents, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def brute(doc_id, text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())

    rows = packing.packed(documents).collect()
    assert Counter(tuple(row[:5]) for row in rows) == Counter(x for d in TEXTS for x in brute(*d))
    ends = {}
    for row in sorted(rows, key=lambda row: (row.sequence_id, row.offset)):
        assert ends.get(row.sequence_id, 0) == row.offset
        ends[row.sequence_id] = row.offset + row.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1
    assert packing.packed(nothing).count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(5)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 400, 300))}
    held = Counter()
    for times, pattern in packing.plan(histogram, rounds=60):
        assert sum(n * c for n, c in pattern.items()) <= 2048
        held.update({n: times * c for n, c in pattern.items()})
    assert held == Counter(histogram)


def test_bpe_encodes_and_decodes_like_the_library(documents, nothing):
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})
    got = Counter((row.doc_id, row.n_tokens, row.ids, bytes(row.decoded)) for row in bpe.coded(documents).collect())
    want = [(i, whole.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS]
    assert got == Counter((i, len(ids), " ".join(map(str, ids)), raw) for i, ids, raw in want)
    assert bpe.coded(nothing).count() == 0


def _shingles(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[at : at + width]) for at in range(len(words) - width + 1)}


def test_join_links_like_brute_force(spark, documents, nothing):
    rng = np.random.default_rng(3)
    base = [f"w{n}" for n in rng.integers(0, 4000, 400)]
    rows = list(TEXTS)
    for at in range(60):  # a chain of near copies, some on either side of the threshold
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(0, len(base)))] = f"new{at}"
        rows.append((100 + at, " ".join(base)))
    frame = spark.createDataFrame([(i, t, "n", 5, 1) for i, t in rows], SCHEMA)
    sets = [_shingles(t, 3) for _, t in rows]
    root = list(range(len(rows)))
    degree = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                degree[a] += 1
                degree[b] += 1
                root[find(a)] = find(b)
    least = {}
    for at, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(at)] = min(doc_id, least.get(find(at), doc_id))
    want = Counter((rows[at][0], len(sets[at]), least.get(find(at)), degree[at]) for at in range(len(rows)))
    assert Counter(map(tuple, near_duplicates.linked(frame, 3, 90, 100).collect())) == want
    kept = near_duplicates.one_of_each(frame, 3, 90, 100)
    assert kept.columns == frame.columns
    wordless = sum(1 for s in sets if not s)
    assert kept.count() == len({find(at) for at in range(len(rows)) if sets[at]}) + wordless
    assert near_duplicates.linked(nothing).count() == 0


def test_subspaces_leave_one_without_a_difference():
    """Every linked pair meets on a page, whatever differs."""
    rng = np.random.default_rng(1)
    for num in (80, 90):
        for size in (9, 12, 40, 333, 1000):
            common = rng.integers(0, 2**63, size).astype(np.uint64)
            differ = (size * (100 - num)) // (100 + num)
            for extra in range(differ + 1):
                a = np.unique(np.concatenate([common[extra:], rng.integers(0, 2**63, extra).astype(np.uint64)]))
                overlap = len(np.intersect1d(a, np.unique(common)))
                if overlap * 100 >= num * (len(a) + size - overlap) and overlap < size:
                    mine = near_duplicates.pages_of(np.unique(common), num, 100)
                    assert np.intersect1d(mine, near_duplicates.pages_of(a, num, 100)).size


def test_recurring_templates_leave_all_but_the_first(spark, nothing):
    stamp = "Request {} was answered by the northern gateway server in the usual time"
    letters = str.maketrans("0123456789", "ghijklmnop")
    line = [" ".join(hashlib.md5(f"{n} {k}".encode()).hexdigest().translate(letters) for k in range(6)) for n in range(8)]
    rows = [(n, f"{line[n]}\n{stamp.format(n)}\nMenu home about contact") for n in range(8)]
    rows += [(20, None), (21, ""), (None, "Menu home about contact"), (22, "two words"), (23, "two words"), (24, "two words")]
    frame = spark.createDataFrame([(i, t, "n", 5, 1) for i, t in rows], SCHEMA)
    got = {row.doc_id: (row.text, row["__lines_dropped"]) for row in line_templates.without_templates(frame).collect()}
    own = {i: (t or "").split("\n")[0] for i, t in rows}
    assert got[None] == ("Menu home about contact", 0)  # the first document, by doc_id, nulls first
    assert got[0] == (own[0] + "\n" + stamp.format(0), 1)
    for n in range(1, 8):
        assert got[n] == (own[n], 2)
    assert got[20] == (None, 0) and got[21] == ("", 0) and got[23] == ("two words", 0)
    assert line_templates.stage(spark, frame, "").columns == frame.columns
    assert line_templates.without_templates(nothing).count() == 0


@pytest.mark.parametrize("part_words", [line_templates.PART_WORDS, 60])
def test_templates_have_one_key_at_every_size(spark, monkeypatch, part_words):
    monkeypatch.setattr(line_templates, "PART_WORDS", part_words)  # small parts: leaders of parts meet again
    rng = np.random.default_rng(7)
    names, desks = ([f"{stem}{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(100)] for stem in ("name", "desk"))
    line = "The reading room was opened for {} who then asked at {} for the keys"
    other = "The reading room was closed because {} had lost them all during {} last night again"
    for size in (20, 200):
        picks = [(names[rng.integers(100)], desks[rng.integers(50)]) for _ in range(size)]
        rows = [(n, line.format(*pick) + "\n" + other.format(*pick)) for n, pick in enumerate(picks)]
        rows.append((size, line.format("odd", "odd").replace("keys", "locks")))
        rows.append((size + 1, "The reading room was a place where nobody of our town ever went"))
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = {row.doc_id: row["__lines_dropped"] for row in line_templates.without_templates(frame).collect()}
        assert got == {0: 0} | {n: 2 for n in range(1, size)} | {size: 1, size + 1: 0}


def test_long_lines_recur_from_two_documents_on(spark):
    def passage(n, words):
        return " ".join(hashlib.md5(f"{n} {k}".encode()).hexdigest() for k in range(words))

    numbers = " ".join(str(n) for n in range(100, 160))
    rows = [(1, passage(1, 50) + "\nown"), (2, "other\n" + passage(1, 50)), (3, numbers), (4, numbers[::-1]),
            (6, passage(6, 49)), (7, passage(6, 49))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {row.doc_id: row.text for row in line_templates.without_templates(frame).collect()}
    assert got == dict(rows) | {2: "other"}  # other numbers are not the same line; 49 words are not long


def test_short_lines_recur_as_they_are_written(spark):
    rows = [(n, f"Home\nPage {n}\n{n}\nRead more\n全部分类\n") for n in range(4)] + [(9, "Read\nmore"), (10, "Page 2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {row.doc_id: row.text for row in line_templates.without_templates(frame).collect()}
    assert got == {0: rows[0][1]} | {n: f"Page {n}\n{n}\n" for n in (1, 2, 3)} | {9: "Read\nmore", 10: "Page 2"}


def test_leaders_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    for size in (5, 6, 9, 14, 30):
        leaders, kept = line_templates.Leaders(size, 4, 0.7), []
        for key in range(300):
            words = ["a", "b", "c", "d", *(str(x) for x in rng.integers(0, 3, size - 4))]
            agree = [k for k, other in kept if sum(x == y for x, y in zip(words, other)) >= 0.7 * size - 1e-9]
            assert leaders.of(key, words) == (agree[0] if agree else key)
            if not agree:
                kept.append((key, words))


def test_classifier_learns_and_scores_any_text(spark, documents, nothing):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.fit(x, y, rounds=60)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    scores = quality.scored(documents, model).collect()
    assert all(0 <= row.score <= 1 for row in scores) and len(scores) == len(TEXTS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    empty = quality.train(nothing, labels)
    assert quality.scored(nothing, empty).count() == 0
    held = {row.doc_id: row.h for row in documents.select("doc_id", quality.held_out("doc_id").alias("h")).collect()}
    assert all(h == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_classifier_on_held_out_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(row.predicted == row.quality for row in rows) >= 0.9 * len(rows)


def test_index_on_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(n, rng.normal(size=8).astype("float32").tolist()) for n in range(120)]
    odd = [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [1.0] * 3), (None, [1.0] * 8),
           (205, [None] + [1.0] * 7), (206, [float("inf")] + [1.0] * 7)]
    same = [(n, good[0][1]) for n in range(300, 340)] + [good[20], good[20]]
    frame = spark.createDataFrame(good + odd + same, "vec_id long, embedding array<float>")
    got = {}
    for row in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=5, pivots=16, order=8).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, round(row.score, 9)))
    rows = {i: np.array(v, dtype=float) for i, v in good + same}
    for query in [i for i in rows if i % 20 == 0]:
        near = sorted((-round(float(v @ rows[query]), 9), i) for i, v in rows.items() if i != query)[:5]
        assert sorted(got[query]) == [(at + 1, i, -s) for at, (s, i) in enumerate(near)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_index_searches_every_length(spark):
    rng = np.random.default_rng(5)
    rows = [(n, rng.normal(size=8 if n < 60 else 5).astype("float32").tolist()) for n in range(100)] + [(100, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for row in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=5, pivots=16, order=8).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    assert set(got) == {0, 20, 40, 60, 80}
    for query, found in got.items():
        v = vectors[query]
        near = sorted((-float(w @ v), i) for i, w in vectors.items() if i != query and len(w) == len(v))[:5]
        assert sorted(found) == [(at + 1, i) for at, (_, i) in enumerate(near)]


def test_wrappers_find_the_article():
    page = (
        "<html><head><title>T</title></head><body><header>H</header><div class='cookie-notice'>n</div><nav><a>m</a></nav>"
        "<article><h1>A &amp; b</h1><p>x<br>y  <b>z</b></p><ul><li>1<li>2</ul><aside>s</aside>"
        "<div class='comments'><p>c</p></div><form>f<input></form><script>var p='</p>'</script><p>end</article><footer>F"
    )
    assert wrappers.text_of(page) == "A & b\n\nx y z\n\n1\n\n2\n\nend"
    assert wrappers.text_of("") == "" and wrappers.text_of("<nav>only</nav>") == ""
    one, two = wrappers.wrapper_of("<body><p>a</p><i>k</i>"), wrappers.wrapper_of("<body><p>b</p><p>c</p><hr><i>k</i>")
    body = wrappers.aligned(one, two)[5][0]
    assert [(n[0], n[1], n[2]) for n in body[5]] == [("p", False, True), ("hr", True, False), ("i", False, False)]
    assert body[5][0][5][0][4] is None and body[5][2][5][0][4] is not None  # a slot; fixed text


def test_wrappers_in_spark(spark):
    same = "<body><div class='top'>Site name here</div><div>Own text {}</div></body>"
    rows = [(n, "http://a.org/x", same.format(n), "old") for n in range(6)] + [(7, None, None, "old"), (8, "x", "", None), (8, "x", "", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((row.page_id, row.text, row.n_chars) for row in wrappers.extracted(frame).collect())
    assert got[(3, "Own text 3", 10)] == 1 and got[(7, "", 0)] == 1 and got[(8, "", 0)] == 2
    assert wrappers.extracted(frame.limit(0)).count() == 0


def test_chat_masks_and_places(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"),
            (2, 5000, "ann", "<|im_end|>"), (None, 1, "bob", "x"), (3, 1, "system", "alone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotated(frame).collect()
    by = {}
    for row in sorted(got, key=lambda row: row["at"]):
        by.setdefault((row.conv_id, row.perspective), []).append(row)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "bob")}
    for (_, speaker), turns in by.items():
        text = "".join(row.segment for row in turns)
        for row in turns:
            assert text[row.start : row.start + len(row.segment)] == row.segment
            learnt = text[row.mask_start : row.mask_end]
            assert bool(learnt) == (row.speaker == speaker) and (not learnt or learnt.endswith("<|im_end|>\n"))
    assert by[(2, "ann")][0].segment.count("<|im_end|>") == 1
    assert chat.rotated(frame.limit(0)).count() == 0


def test_lists_hold_captures_by_time(spark):
    entries = [("spam", "b.org", 100, "add"), ("spam", "b.org", 200, "remove"), ("spam", "b.org", 200, "add"),
               ("adult", "x.b.org", 150, "add"), ("spam", None, 1, "add"), ("spam", "c.org", 50, "other")]
    captures = [("http://x.b.org/1", 99), ("http://x.b.org/1", 100), ("HTTP://X.B.ORG:80", 150), ("http://b.org", 200),
                ("http://xb.org", 150), (None, 150), ("http://b.org", None), ("http://b.org", 150), ("http://b.org", 150)]
    found = url_lists.judged(
        spark.createDataFrame(captures, "url string, fetched_at long").withColumn("domain", F.lit("clash")),
        spark.createDataFrame(entries, "list string, domain string, at long, action string"),
        (0, 1000),
    )
    got = Counter((row.url, row.fetched_at, tuple(row.lists), row.allowed) for row in found.collect())
    lists = [(), ("spam",), ("adult", "spam"), (), (), (), (), ("spam",), ("spam",)]
    assert got == Counter((u, t, held, not held) for (u, t), held in zip(captures, lists))


def test_lists_hold_captures_outside_the_horizon(spark):
    entries = [("spam", "b.org", 10, "add"), ("spam", "b.org", 40, "remove"), ("spam", "c.org", 2000, "add"),
               ("adult", "c.org", 900, "add"), ("adult", "c.org", 3000, "remove")]
    captures = [("http://b.org", 5), ("http://b.org", 20), ("http://b.org", 50), ("http://c.org", 1500),
                ("http://c.org", 2500), ("http://c.org", 2 * url_lists.SLICE)]
    found = url_lists.judged(
        spark.createDataFrame(captures, "url string, fetched_at long"),
        spark.createDataFrame(entries, "list string, domain string, at long, action string"),
        (100, 1000),
    )
    got = {(row.url, row.fetched_at): tuple(row.lists) for row in found.collect()}
    assert got == dict(zip(captures, [(), ("spam",), (), ("adult",), ("adult", "spam"), ("spam",)]))
