"""The methods themselves, against brute force; hard rows; the pipeline's stages."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import LABELS, hard_rows, linked, luhn, measures, number, table

import corpus_pipeline
from stepwise.llm import exact_dedup, language_id, mixing, ngram_join, packing, pii, quality, secrets, sharding, toxicity
from stepwise.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def squared_scores(value, alphabet):
    x = [alphabet.index(c) + 1 for c in value]
    n, m = len(x), len(alphabet)
    chi = sum(c * c for c in Counter(x).values()) * m / n - n
    uniform = (chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
    high = [2 * a > m for a in x]
    expected = 2 * sum(high) * (n - sum(high)) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = sum(x) / n
    variance = sum((a - mean) ** 2 for a in x)
    together = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False))
    return uniform**2 + ((runs - expected) ** 2 / spread if spread > 0 else n) + ((together / variance) ** 2 * n if variance > 1e-9 else n)


def test_battery_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for name, (_, signs) in secrets.ENCODINGS.items():
        rows += [("".join(rng.choice(signs) for _ in range(rng.randint(16, 90))), name) for _ in range(20)]
        rows += [(signs[0] * 20, name), (signs * 3, name), ((signs[0] + signs[-1]) * 10, name), ("".join(rng.choice(signs) for _ in range(2 * secrets.PART + 7)), name)]
    for r in secrets.tested(spark.createDataFrame(rows, "v string, encoding string")).collect():
        assert r.statistic == pytest.approx(squared_scores(r.v, secrets.ENCODINGS[r.encoding][1]), rel=1e-6, abs=1e-6)


def found_cells(rows, rate):
    """Benjamini-Hochberg with Storey's estimate for each encoding and length class, on single strings."""
    out = set()
    for group in {(r.encoding, r.level) for r in rows if r.asked}:
        null = [r.bin for r in rows if not r.asked and r.encoding == group[0] and r.level <= group[1]]
        own = [r.bin for r in rows if r.asked and (r.encoding, r.level) == group]
        p = {b: (sum(x <= b for x in null) + 1) / (len(null) + 1) if null else 0.0 for b in own}
        chance = min(1, (1 + sum(p[b] > 0.5 for b in own)) / (0.5 * len(own)))
        passing = [p[b] for b in own if p[b] * chance <= rate * sum(p[c] <= p[b] for c in own) / len(own)]
        out |= {(*group, b) for b in own if passing and p[b] <= max(passing) and b * secrets.BIN <= secrets.REJECTED}
    return out


def test_false_discovery_control_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("v", rng.choice(["hex", "base36", "base62"]), rng.randint(1, 3), int(rng.expovariate(0.02)) if rng.random() < 0.7 else rng.randint(0, 30), rng.random() < 0.5) for _ in range(800)]
    frame = spark.createDataFrame(rows, "v string, encoding string, level int, bin int, asked boolean")
    for rate in (0.01, 0.05, 0.3):
        got = {tuple(r) for r in secrets.discoveries(frame.filter("asked"), frame.filter("NOT asked"), rate).collect()}
        assert got == found_cells(frame.collect(), rate)


@pytest.mark.parametrize(("name", "size"), [("hex", 32), ("base36", 32), ("base62", 24), ("base64", 32), ("base26", 64), ("base52", 32)])
def test_keys_of_no_known_form(spark, name, size):
    rng = random.Random(3)
    signs = secrets.ENCODINGS[name][1].upper() if name == "hex" else secrets.ENCODINGS[name][1]
    keys = ["".join(rng.choice(signs) for _ in range(size)) for _ in range(40)]
    words = ["".join(rng.choice(["tion", "the", "ing", "ent", "ere"]) for _ in range(9)) for _ in range(300)]
    rows = [(i, f"x {k} y {words[i]}", "en", "s") for i, k in enumerate(keys)] + [(1000 + i, w, "en", "s") for i, w in enumerate(words)]
    rows.append((5000, f'token = "{keys[0]}"', "en", "s"))
    out = {r.doc_id: r for r in secrets.scan(spark, table(spark, rows), redacted=True).collect()}
    assert sum(out[i].n_random for i in range(40)) >= 38
    assert all("<RANDOM>" in out[i].redacted for i in range(40) if out[i].n_random)
    assert not any(out[1000 + i].n_random for i in range(300))
    assert (out[5000].n_assign, out[5000].n_random) == (1, 0)


def test_long_runs_take_linear_time(spark):
    rng = random.Random(4)
    signs = secrets.ENCODINGS["base64"][1]
    secrets.scan(spark, table(spark, [(1, "x", "en", "s")])).collect()
    for size, most in ((10_000, 20), (1_000_000, 40)):
        began = time.time()
        out = secrets.scan(spark, table(spark, [(1, "".join(rng.choices(signs, k=size)), "en", "s")])).first()
        assert out.n_random == 1
        assert time.time() - began < most


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= len(number(m[0])) <= 19 and luhn(number(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m[0])) <= 15),
]


def sensitive_words(texts, disclosed, support):
    """Which words of which texts the disclosure of terms tags."""
    held, alone, joint, values, near = Counter(), Counter(), Counter(), defaultdict(set), []
    spans = [[(k, m) for k, form, holds in KINDS for m in re.finditer(form, t) if holds(m)] for t in texts]
    terms = []
    for text, own in zip(texts, spans, strict=True):
        outside = list(text)
        for _, m in own:
            outside[m.start() : m.end()] = "\n" * (m.end() - m.start())
        terms.append(set(re.findall(r"\w+", "".join(outside).lower())))
        there = {(k, m[0]) for k, m in own}
        near.append({(k, None) for k, _ in there} | there | ({("any", None)} if there else set()))
        held.update(near[-1])
        alone.update(terms[-1])
        joint.update((t, x) for t in terms[-1] for x in near[-1])
    for own, there in zip(terms, near, strict=True):
        for t in own:
            for k, v in there:
                if v:
                    values[t, k].add(v)
                    if held[k, v] == 1:
                        values[t, "any"].add((k, v))

    def tells(t, x):
        enough = len(values[t, x[0]]) >= support if x[1] is None else held[x] > 1 and joint[t, x] >= pii.TOGETHER
        information = math.log2(len(texts) / held[x])
        return enough and information > 0 and math.log2(joint[t, x] * len(texts) / (alone[t] * held[x])) / information >= disclosed - 1e-12

    return [{t for t in own if any(tells(t, x) for x in there)} for own, there in zip(terms, near, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_disclosure_against_brute_force(spark, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(300):
        words = rng.choices(plain, k=rng.randint(3, 12))
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice([f"mail{i}@host{i % 3}.example", f"shared{i % 5}@host.example", f"10.0.{i % 7}.{i % 200}", "+1 (222) 333-4444"]))
            words += rng.choices(["contact", "reach", "Kim", "mail", "host"], k=2)
        if i % 50 == 0:
            words += ["contact", "host"]
        texts.append(" ".join(words))
    want = sensitive_words(texts, 0.6, 8)
    assert any(want)
    for r in pii.find(spark, table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), disclosed=0.6).collect():
        got = {texts[r.doc_id][int(a) : int(b)].lower() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
        assert got == want[r.doc_id], texts[r.doc_id]


def test_terms_are_found_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = pii.find(spark, docs).filter("n_term > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    tagged = Counter(r.text[int(a) : int(b)].lower() for r in out for k, a, b in (x.split(":") for x in r.spans.split(",")) if k == "term")
    assert tagged["token"] >= 50
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone for r in out)


def test_families_of_rules():
    """A bad vote that nothing contradicts speaks against a text; one that its family outvotes doesn't."""
    families = tuple(tuple(list(quality.RULES).index(x) for x in f) for f in quality.FAMILIES)
    counts = {"gggggg": 7500, "ggbggg": 600, "-ggggg": 400, "gggbgg": 14, "ggggbb": 220, "gggbb-": 140, "gggbbb": 60, "bgbggg": 8}
    for scale in (0.02, 1, 50):
        found = quality.posterior({p: round(n * scale) for p, n in counts.items() if round(n * scale)}, families)
        assert found["gggggg"] > 0.9
        assert found["ggbggg"] < 0.5
        assert found["gggbb-"] < 0.1
        assert found.get("gggbgg", 1) > 0.5
        assert found.get("bgbggg", 0) < 0.5
    assert quality.posterior({}) == {}


def test_verdicts_agree_with_labels(spark):
    """Labels of quality are no input; of texts that pass the base rules, the verdict must tell them apart."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.judged(spark, docs).filter("NOT base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    low, high = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert len(low) > 200
    assert sum(low) <= 0.05 * len(low)
    assert sum(high) >= 0.98 * len(high)


def test_long_texts_need_bounded_memory():
    words = np.random.default_rng(1).integers(97, 123, 6_000_000).astype(np.uint8)
    words[::7] = 32
    text = words.tobytes().decode()
    for one in (text, text[:3_000_000].replace(" ", "")):
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([one], pa.string())], ["doc_id", "text"])
        tracemalloc.start()
        out = next(quality.measured(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 * len(one)
        assert out.column(1).to_pylist() == [len(one.split())]
    assert [c.as_py() for c in (out.column(k)[0] for k in range(1, 6))] == list(measures(text[:3_000_000].replace(" ", "")))


def weighted(sizes, weights=mixing.WEIGHTS, most=mixing.MOST_ROUNDS):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: weights[i % len(weights)] for i, s in enumerate(order)}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and most * sizes[s] * share <= weight[s] * left}
        if not more:
            return {s: float(most * sizes[s]) if s in full else weight[s] * (left / share) for s in order}
        full |= more


def queued_fairly(rows, most=mixing.MOST_ROUNDS):
    """Words taken by (row, round), by serving parts one by one in order of their finish."""
    keys = [int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16) for r in rows]
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    goal, parts = weighted(dict(total)), []
    for place, source in enumerate(sorted(total, key=lambda s: (s is None, s or ""))):
        own = sorted((i for i, r in enumerate(rows) if r[3] == source), key=lambda i: (keys[i], rows[i][0] is not None, rows[i][0] or 0, size[i]))
        for k in range(most):
            at = total[source] * k
            for i in own:
                for head in range(0, size[i], mixing.PART):
                    words = min(mixing.PART, size[i] - head)
                    parts.append(((at + head + words) / goal[source], place, at + head + words, words, i, k))
                at += size[i]
    left, taken = sum(size), Counter()
    for *_, words, i, k in sorted(parts):
        taken[i, k] += min(words, left)
        left -= min(words, left)
    return taken, size, goal


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_serving_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 3, 40, 200, 700]), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(250)]
    taken, size, goal = queued_fairly(rows)
    docs = table(spark, rows)
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    served = Counter()
    for i, _, _, source in rows:
        assert out[i].taken == sum(taken[i, k] for k in range(3))
        assert out[i].size == size[i]
        assert out[i].target == pytest.approx(goal[source], rel=1e-12)
        served[source] += out[i].taken
    assert sum(served.values()) == sum(size)
    assert all(abs(served[s] - goal[s]) <= mixing.PART for s in goal)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r.doc_id: tuple(r) for r in again} == {i: tuple(r) for i, r in out.items()}
    whole = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert whole == Counter(i for (i, _), n in taken.items() if size[i] and 2 * n >= size[i])


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 10, 1000, 100_000]) for i in range(500)} | {None: 77}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long").repartition(5)).collect()}
    want = weighted(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)


def test_pages_and_written_shards(spark, tmp_path):
    rows = [(5, "y" * 900, "en", "s")] * 60 + [(i, "x" * 500, "en", "s") for i in range(100, 200)]
    one, two = (sorted((r.doc_id, r.shard, r.shard_bytes, r.shard_docs) for r in sharding.shards(spark, table(spark, rows), limit=5000).collect()) for _ in range(2))
    assert one == two
    sizes = Counter()
    for key, shard, *_ in one:
        sizes[shard] += 900 if key == 5 else 500
    assert all(n <= 5000 and sizes[s] == n for _, s, n, _ in one)
    docs = table(spark, rows[60:])
    sharding.write_shards(docs, sharding.shards(spark, docs, limit=5000), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(100, 200))


def test_every_label_is_learnt(spark):
    rows = [(i, f"{chr(0x4E00 + i % 230) * 8} {i}", f"l{i % 230}", "s") for i in range(2300)]
    rows += [(9000 + i, "long " * 6000, "only_long", "s") for i in range(5)] + [(1, "same", "en", "s")] * 50
    texts, names = language_id.sample(table(spark, rows))
    assert set(names) == {f"l{i}" for i in range(230)} | {"only_long", "en"}
    assert Counter(names)["en"] == 1
    assert min(Counter(names)[f"l{i}"] for i in range(230)) >= 5


def test_join_finds_what_a_twentieth_of_all_rows_asks_for(spark):
    """Every link of each row whose id divides by 20, against all rows of a table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sets, holders = {}, defaultdict(list)
    for i, text in rows.items():
        w = text.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        for s in sets[i]:
            holders[s].append(i)
    label = {r.doc_id: r.class_id for r in ngram_join.near_copies(spark, docs).collect()}
    met = missed = 0
    for i in rows:
        if i % 20 == 0:
            shared = Counter(j for s in sets[i] for j in holders[s] if j != i)
            for j, n in shared.items():
                if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                    met += 1
                    missed += label[i] != label[j]
    assert met > 20
    assert missed <= (1 - ngram_join.RECALL) * met


def test_toxic_documents_are_recalled(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out AND toxic = 1").collect()
    assert sum(r.predicted for r in rows) >= 0.75 * len(rows)


# Hard rows: nulls, empty and blank texts, repeats, long texts, a real id that is the least
# possible, and columns whose names operators use inside.
NAMES = ["row", "key", "kept_sum", "kept_id", "mark", "unnamed", "id", "sum", "turn", "size", "part", "of", "n", "d", "before"]


def clashing(spark):
    rows = [*hard_rows(), (-(2**63), "the least id", "en", "a"), (None, "the least id", "en", "a"), (11, "one two", None, "a")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in NAMES)}"
    return rows, spark.createDataFrame([(*r, 3, *[f"{n}-{i}" for n in NAMES]) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("place", range(4))
def test_stages_keep_hard_rows_whole(spark, place):
    name, stage = corpus_pipeline.STAGES[place]
    rows, docs = clashing(spark)
    out = stage(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SMALL).collect() == []
    got = out.collect()
    given = [tuple(r) for r in docs.collect()]
    assert all(tuple(r) in given for r in got)
    kept = Counter((r.doc_id, r.text) for r in got)
    if name == "toxicity":
        assert sum(kept.values()) == len(rows)
    if name == "exact_dedup":
        last = {}
        for i, t, *_ in rows:
            last[t or ""] = max(last.get(t or "", (False, 0)), (i is not None, i or 0))
        assert Counter((i, t or "") for i, t in kept.elements()) == Counter((x[1] if x[0] else None, t) for t, x in last.items())
    if name == "ngram_join":
        wordless = {(i, t) for i, t, *_ in rows if not (t or "").split()}
        assert {x for x in kept if x in wordless} == {(i, t) for i, t in wordless if t is not None or (i, "") not in wordless}
        heads = {}
        for i, t, *_ in rows:
            if (t or "").split():
                w = tuple(t.split())
                heads[w] = min(heads.get(w, (True, 0)), (i is None, i or 0))
        assert Counter((i, tuple(t.split())) for i, t in kept.elements() if (t or "").split()) == Counter((None if x[0] else x[1], w) for w, x in heads.items())
    if name == "mixing":
        assert all((t or "").split() for _, t in kept)
        assert max(kept.values()) <= 6


def test_packing_stage_takes_hard_rows(spark):
    rows, docs = clashing(spark)
    out = corpus_pipeline.STAGES[4][1](spark, docs, SMALL).collect()
    ends = Counter(r.doc_id for r in out if r.start + r.length == r.doc_tokens)
    assert ends == Counter(r[0] for r in rows)
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SMALL).collect() == []


def test_hard_rows_have_their_values(spark):
    rows, docs = clashing(spark)
    text = lambda r: r[1] or ""
    dedup = exact_dedup.exact_copies(spark, docs).collect()
    assert Counter(r.text_sha256 for r in dedup) == Counter(hashlib.sha256(text(r).encode()).hexdigest() for r in rows)
    assert all(r.group_size == sum(hashlib.sha256(text(x).encode()).hexdigest() == r.text_sha256 for x in rows) for r in dedup)
    assert sum(r.kept for r in dedup) == len({text(r) for r in rows})
    judged = quality.judged(spark, docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == Counter((r[0], *measures(text(r))) for r in rows)
    assert Counter((r.doc_id, r.size) for r in mixing.mix(docs).collect()) == Counter((r[0], measures(text(r))[0]) for r in rows)
    assert Counter((r.doc_id, r.n_bytes) for r in sharding.shards(spark, docs).collect()) == Counter((r[0], len(text(r).encode())) for r in rows)
    label, links = linked([(k, r[1]) for k, r in enumerate(rows)])
    joined = Counter((r.doc_id, r.n_links) for r in ngram_join.near_copies(spark, docs).collect())
    assert joined == Counter((r[0], links[k]) for k, r in enumerate(rows))
    for made in (pii.find(spark, docs), secrets.scan(spark, docs)):
        assert {r.base_sha256 for r in made.collect()} == {hashlib.sha256(b"").hexdigest()}
    languages = Counter((r.doc_id, r.lang_pred == "und", r.score == 0) for r in language_id.identify(docs).collect())
    wordy = lambda t: any(c.isalpha() for c in t)
    assert Counter((i, u) for i, u, _ in languages.elements()) == Counter((r[0], not wordy(text(r))) for r in rows)
    scores = toxicity.score(docs, spark.createDataFrame([(2, 1, 1), (3, 0, None), (None, 1, 0)], LABELS)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scores)
    assert Counter((r.doc_id, r.held_out) for r in scores) == Counter((r[0], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 1) for r in rows)


def test_pipeline_against_brute_force(spark):
    """All five stages on a whole table; only the scores of toxicity are taken as they are."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r.doc_id: r.score for r in docs.select("doc_id", toxicity.toxicity(model).alias("score")).collect()}
    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in docs.collect() if scores[r.doc_id] < toxicity.THRESHOLD]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r, key=lambda x: x[0])
    rows = sorted(last.values())
    label, _ = linked(rows)
    rows = [r for r in rows if label[r[0]] == r[0]]
    taken, size, _ = queued_fairly(rows)
    times = Counter(rows[i][0] for (i, _), n in taken.items() if size[i] and 2 * n >= size[i])
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 0] for r in rows if r[0] in times}
    out = corpus_pipeline.run(spark, SMALL).collect()
    pieces, used = defaultdict(Counter), defaultdict(list)
    for p in out:
        pieces[p.doc_id][p.start, p.length] += 1
        assert p.ids_crc32 == zlib.crc32(packing.packed(ids[p.doc_id][p.start : p.start + p.length]))
        used[p.sequence_id].append((p.offset, p.length))
    assert pieces.keys() == times.keys()
    for i, own in pieces.items():
        covered = Counter(k for (start, length), n in own.items() for k in range(start, start + length) for _ in range(n))
        assert covered == Counter(dict.fromkeys(range(len(ids[i])), times[i]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or not at & (at - 1)
