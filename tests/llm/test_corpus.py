import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwise.llm import exact_dedup, language_id, mixing, ngram_join, packing, pii, quality, secrets, sharding, toxicity
from stepwise.llm.common import with_groups
from stepwise.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row string"
LABELS = "doc_id long, toxic int, quality int"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names might clash."""
    return spark.createDataFrame([(*r, 1, 2, "k", "r") for r in rows], SCHEMA)


def hard_rows():
    return [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "a b c d e f g", None, "b"), (None, None, "fr", "b"), (7, "x " * 60_000, "fr", "b"), (8, "é" * 5000, "fr", None), (9, " \n\t ", "en", "c"), (10, "a b c d e f g", "en", "c")]


OPERATORS = {
    "sharding": lambda s, d: sharding.shards(s, d, limit=50_000),
    "dedup": exact_dedup.exact_copies,
    "language": lambda s, d: language_id.identify(d),
    "toxicity": lambda s, d: toxicity.score(d, s.createDataFrame([(2, 1, 1), (3, 0, None), (None, 1, 0), (7, None, 1)], LABELS)),
    "pii": pii.find,
    "join": ngram_join.near_copies,
    "secrets": secrets.scan,
    "mixing": lambda s, d: mixing.mix(d),
    "quality": quality.judged,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows_and_empty_table(spark, name):
    rows = hard_rows()
    out = OPERATORS[name](spark, table(spark, rows)).collect()
    assert sorted(r.doc_id or 0 for r in out) == sorted(r[0] or 0 for r in rows)
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


def test_packing_hard_rows(spark):
    out = packing.pack(spark, table(spark, hard_rows()), tokenizer_path()).collect()
    assert {r.doc_id for r in out} == {r[0] for r in hard_rows()}
    gapless(out)
    assert packing.pack(spark, table(spark, []), tokenizer_path()).count() == 0


def gapless(pieces):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return by


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(5)
    signs = ["the", " and", "\n", "  ", "é", "ß", "漢", "1234", "'re", "!?", "\x1c", "\xa0", "²", "<|endoftext|>", "_", "zzzz", "\r\n "]
    rows = [(i, "".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.choice([0, 3, 50, 700, 1500]))), "en", "s") for i in range(150)]
    rows += [(1000 + i, "same text " * 200, "en", "s") for i in range(60)]
    out = packing.pack(spark, table(spark, rows), tokenizer_path()).collect()
    pieces = defaultdict(list)
    for p in out:
        pieces[p.doc_id].append(p)
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            assert p.start == at
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(packing.packed(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    padding = sum(1024 - n for parts in gapless(out).values() if (n := sum(x[1] for x in parts)) & (n - 1))
    assert padding == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([700, 900, rng.randint(1, 1023), rng.randint(500, 1023)]) for _ in range(rng.choice([1, 30, 3000])))
    rules, sequences = packing.plan(dict(histogram))
    assert sequences <= sum(k * v for k, v in histogram.items()) / 1024 + 11
    for length, own in rules.items():
        at = 0
        for rule in own:
            assert rule[1] == at, length
            at = rule[2]


def test_best_fill_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        room = rng.randint(1, 80)
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * i for s in sums for i in range(v + 1)}
        used = packing.best_fill(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("parts", [1000, 10, 1])
def test_rows_meet_their_groups(spark, parts):
    keys = ["hot"] * 60 + ["b"] * 30 + [f"k{i}" for i in range(30)] + [None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, key string")
    groups = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    size = Counter(keys)
    out = with_groups(rows, groups, "key", "n", parts).collect()
    assert sorted((r.i, r.key, r.n) for r in out) == [(i, k, size[k]) for i, k in enumerate(keys) if k]


def test_dedup_verifies_identifiers(spark):
    rng = random.Random(2)
    words = [str(i) for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    rows = [(i, texts[i % 37], "en", "s") for i in range(80)] + [(100, "same", "en", "s"), (100, "same", "en", "s")]
    for kinds in (exact_dedup.DIGESTS, ("xxh3_8", "xxh3_128")):
        out = exact_dedup.exact_copies(spark, table(spark, rows), kinds).collect()
        for r in out:
            text = next(t for i, t, *_ in rows if i == r.doc_id)
            same = [i for i, t, *_ in rows if t == text]
            assert (r.keep_id, r.group_size, r.text_sha256) == (max(same), len(same), hashlib.sha256(text.encode()).hexdigest())
        assert sum(r.kept for r in out) == len({t for _, t, *_ in rows})
    assert exact_dedup.verified_digest(table(spark, rows), ("xxh3_8", "xxh3_128")) == "xxh3_128"
    assert exact_dedup.without_copies(spark, table(spark, rows)).count() == len({t for _, t, *_ in rows})


def test_shards_fit(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 3000), "en", "s") for i in range(800)] + [(5000, "y" * 900, "en", "s")] * 40 + [(6000, "z" * 20_000, "en", "s")]
    out = sharding.shards(spark, table(spark, rows), limit=10_000, bits=2).collect()
    size = Counter()
    for r in out:
        size[r.shard] += r.n_bytes
    assert len(out) == len(rows)
    assert all(r.shard_bytes == size[r.shard] for r in out)
    assert [s for s in size.values() if s > 10_000] == [20_000]
    heads = [s for s in size if "/" not in s]
    assert not any(a != b and b.startswith(a) for a in heads for b in heads)


def linked(rows):
    sets, words = {}, {}
    for i, t, *_ in rows:
        w = tuple((t or "").encode().split())
        sets[i], words[i] = ({w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} - {()}), w
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    label = {}
    for i in sorted(sets):
        todo = [] if i in label else [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x]
    return label, {i: len({words[j] for j in near[i]} - {words[i]}) for i in sets}


@pytest.mark.parametrize("sizes", [{}, {"small": 5, "block": 4}, {"most": 6000}])
def test_join_against_brute_force(spark, sizes):
    rng = random.Random(6)
    rows, heads = [], [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 200))] for _ in range(12)]
    for i in range(160):
        text = list(heads[rng.choice([0, 0, 0, *range(12)])])
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(text), "en", "s"))
    rows += [(500 + i, "a b c", "en", "s") for i in range(3)] + [(600, "", "en", "s"), (601, None, "en", "s")]
    label, links = linked(rows)
    out = ngram_join.near_copies(spark, table(spark, rows), **sizes).collect()
    assert {r.doc_id: r.class_id for r in out} == label
    assert {r.doc_id: r.n_links for r in out} == links
    assert sum(r.kept for r in out) == len(set(label.values()))


def test_join_rows_grow_no_faster_than_a_family(spark, monkeypatch):
    """A family in blocks: twice the texts make twice the rows, but for a row or two a pair of blocks, and all links are counted."""
    rows, plain = {}, ngram_join.written

    def counted(session, frame, name):
        out = plain(session, frame, name)
        rows[n][name] = max(rows[n].get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    for n in (60, 120):
        rows[n] = {}
        texts = [[f"w{k}" for k in range(150)] for _ in range(n)]
        for i, text in enumerate(texts):
            text[i + 10] = f"n{i}"
        out = ngram_join.near_copies(spark, table(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]), small=5, block=20).collect()
        assert {(r.class_id, r.n_links) for r in out} == {(0, n - 1)}
    grown = {k: (rows[60][k], rows[120][k]) for k in rows[60]}
    assert {k: v for k, v in grown.items() if v[1] > 2.5 * v[0] + 20} == {}


def test_join_ties_what_several_blocks_connect():
    """Nodes 1, 2 and 3 share heads in turn, 4 has one of its own and 5 none."""
    found = pa.table({"path": [9, 9], "side": [0, 0], "node": [[1, 2, 3, 4, 5]] * 2, "head": [[20, 20, 30, -1, -1], [-1, 10, 10, 40, -1]], "links": [[1, 2, 1, 0, 0], [0, 3, 1, 2, 0]]})
    out = ngram_join.gathered(found).to_pylist()
    links = {}
    for r in out:
        links[r["node"]] = links.get(r["node"], 0) + r["links"]
    assert links == {1: 1, 2: 5, 3: 2, 4: 2}
    star = {h: ngram_join.star_id(9, h) for h in (10, 20, 30, 40)}
    of = {i: {r["star"] for r in out if r["node"] == i} for i in links}
    assert of[4] == {star[40]}
    assert all(star[10] in of[i] for i in (1, 2, 3))
    assert of[1] | of[2] | of[3] == {star[10], star[20], star[30]}


@pytest.mark.parametrize(("values", "small"), [(1 << 30, 400), (40, 100)])
def test_recall_of_pairs_at_the_threshold(spark, values, small):
    rng, n = random.Random(12), 20_000
    rows = []
    for i in range(n):
        one = [rng.randrange(values) for _ in range(ngram_join.TOKENS)]
        rows += [(2 * i, one), (2 * i + 1, [t if rng.random() < 0.8 else values + rng.randrange(values) for t in one])]
    tasks = ngram_join.buckets(spark, spark.createDataFrame(rows, "node long, tokens array<int>"), small=small).filter("side = 0")
    met = tasks.groupBy("task", F.floor(F.col("node") / 2).alias("pair")).agg(F.countDistinct("node").alias("n")).filter("n = 2")
    found = met.select("pair").distinct().count()
    assert found >= ngram_join.RECALL * n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def number(text):
    return re.sub("[^0-9]", "", text)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(number(m[0])) <= 19 and luhn(number(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def digest(text, kinds):
    found = [(m.start(), i, m.end(), kind) for i, (kind, form, holds) in enumerate(kinds) for m in re.finditer(form, text) if holds(m)]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    return hashlib.sha256(listed.encode()).hexdigest()


@pytest.mark.parametrize(("find", "kinds", "parts"), [(pii.find, PII, ["4111111111111111", "1.2.3.4", "a@b.c", "+1 (222) 333-4444", " ", "-", ".", "x", "0", "😀", "@", "999.1"]), (secrets.scan, SECRETS, ["token", "PassWord", "api_key", "=", ":", " ", '"', "abcdef123456", "deadbeefdeadbeef", "AKIA", "ABCDEFGHIJ12345678", "é", "😀", "."])])
def test_base_spans_against_brute_force(spark, find, kinds, parts):
    rng = random.Random(7)
    texts = ["", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)], "".join(f"{p} " for p in parts) * 100]
    out = find(spark, table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert all(r.base_sha256 == digest(texts[r.doc_id], kinds) for r in out)


def test_disclosing_terms_and_sanitised_text(spark):
    rows = [(i, f"plain words stand here number{i % 7} zanzibar mail{i}x@host.example", "en", "s") for i in range(20)] + [(100 + i, "plain words stand here without", "en", "s") for i in range(200)]
    out = {r.doc_id: r for r in pii.find(spark, table(spark, rows), sanitised=True).collect()}
    assert "<TERM>" in out[3].sanitised
    assert "zanzibar" not in out[3].sanitised
    assert "<EMAIL>" in out[3].sanitised
    assert out[150].spans == ""


def test_every_entity_of_a_document_counts(spark):
    rows = [(i, f"list@host.example zanzibar mail{i % 9}x@host.example and fax{i}y@host.example", "en", "s") for i in range(20)] + [(100 + i, "plain words stand here without", "en", "s") for i in range(200)]
    rows += [(400 + i, f"list@host.example quagga lone@host.example x{i}", "en", "s") for i in range(20)]
    out = {r.doc_id: r for r in pii.find(spark, table(spark, rows), sanitised=True).collect()}
    assert all("zanzibar" not in out[i].sanitised for i in range(20))


def test_terms_that_disclose_one_entity(spark):
    rows = [(i, f"quagga{'x' * i} wrote from lone{i % 3}@host.example {['quokka', 'numbat', 'bilby'][i % 3]}", "en", "s") for i in range(9)] + [(100 + i, "they wrote plain words", "en", "s") for i in range(400)]
    out = {r.doc_id: r for r in pii.find(spark, table(spark, rows), sanitised=True).collect()}
    assert not any(w in out[i].sanitised for i in range(9) for w in ("quokka", "numbat", "bilby"))
    assert all("wrote" in out[i].sanitised for i in range(9))


def test_short_terms_and_terms_with_digits(spark):
    rows = [(i, f"ask Kim or {i} 李 or user42 at mail{i}x@host.example", "en", "s") for i in range(20)] + [(100 + i, "ask or stand at 7 words", "en", "s") for i in range(200)]
    out = {r.doc_id: r for r in pii.find(spark, table(spark, rows), sanitised=True).collect()}
    assert out[3].sanitised == "ask <TERM> or 3 <TERM> or <TERM> at <EMAIL>"


def test_battery_tells_keys_from_words(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(32)) for _ in range(60)]
    words = ["".join(rng.choice(["tion", "the", "ing", "ent", "ere"]) for _ in range(9)) for _ in range(400)]
    rows = [(i, f"x {k} y", "en", "s") for i, k in enumerate(keys)] + [(1000 + i, w, "en", "s") for i, w in enumerate(words)]
    out = secrets.scan(spark, table(spark, rows)).collect()
    assert sum(r.n_random for r in out if r.doc_id < 1000) >= 54
    assert sum(r.n_random for r in out if r.doc_id >= 1000) == 0


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(9)
    parts = ["a", "bb", "ccc", "é", "漢字", "#", "*x", "\n", "\n", " ", "\t", "\x0b", "\xa0", "\x1c", "a bb ccc ", "\n a"]
    texts = ["", *["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(400)]]
    for r in quality.judged(spark, table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_posterior_recovers_accuracies():
    rng = random.Random(10)
    counts, truth = Counter(), defaultdict(list)
    for _ in range(5000):
        good = rng.random() < 0.7
        pattern = "".join("-" if rng.random() < 0.2 else "gb"[(rng.random() < right) != good] for right in (0.9, 0.85, 0.8, 0.75, 0.7, 0.6))
        counts[pattern] += 1
        truth[pattern].append(good)
    found = quality.posterior(dict(counts))
    right = sum((found[p] >= 0.5) == g for p, gs in truth.items() for g in gs)
    assert right / 5000 > 0.88


def test_mix_targets_and_words(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 10), (None, 90)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(sources).collect()} == {"b": 30.0, "a": 5 * (170 / 6), None: 1 * (170 / 6)}
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    out = mixing.mix(table(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    # Documents of at most 40 words are served whole, up to the one that is cut.
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert sum(taken.values()) == sum(r.size for r in out)
    order = lambda rows: sorted(rows, key=lambda r: r.doc_id)
    assert order(mixing.mix(table(spark, rows)).collect()) == order(out)
    whole = mixing.mixed_documents(table(spark, rows))
    assert whole.columns == table(spark, []).columns
    assert whole.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_language_and_toxicity_on_held_out_rows(spark):
    # The smallest table with over a hundred held-out toxic rows.
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert above > 0.85
    assert sum(b >= 0.7 for b in clean) <= 0.06 * len(clean)


def test_rare_languages_of_their_own_scripts():
    rng = random.Random(13)

    def texts(signs, n, size):
        lexicon = ["".join(rng.choice(signs) for _ in range(rng.randint(2, 7))) for _ in range(400)]
        return [" " + " ".join(rng.choice(lexicon) for _ in range(size)) + " " for _ in range(n)]

    made = [(x, f"common{k}") for k in range(4) for x in texts("abcdefghijklmnopqrstuvwxyz", 150, 300)]
    rare = [(x, name) for name, signs in (("el", "αβγδεζηθικλμνξοπρστυφχψω"), ("ka", "აბგდევზთიკლმნოპჟრსტუფქ")) for x in texts(signs, 60, 20)]
    asked, learnt = rare[::2], rare[1::2]
    model = language_id.fit(*map(list, zip(*made, *learnt)))
    data = b"".join(x.encode() for x, _ in asked)
    starts = [0]
    for x, _ in asked:
        starts.append(starts[-1] + len(x.encode()))
    data, starts = np.frombuffer(data, np.uint8), np.array(starts)
    own = language_id.presence(data, starts, language_id.SIZES, model.columns, model.landmarks.shape[0]).sum(1)
    assert own.min() >= 40
    found = model.scores(data, starts).argmax(1)
    assert [model.languages[k] for k in found] == [name for _, name in asked]


def test_every_language_has_landmarks():
    names = [f"l{k:03d}" for k in range(200)]
    signs = [chr(0x4E00 + 40 * k + j) for k in range(200) for j in range(40)]
    text = lambda k, i: " " + "".join(signs[40 * k + (7 * i + j * (i + 1)) % 40] for j in range(12)) + " "
    model = language_id.fit([text(k, i) for k in range(200) for i in range(3)], [x for x in names for _ in range(3)])
    assert model.landmarks.shape[1] >= 200
    raw = [text(k, 5).encode() for k in range(200)]
    starts = np.cumsum([0, *map(len, raw)])
    found = model.scores(np.frombuffer(b"".join(raw), np.uint8), starts).argmax(1)
    assert [model.languages[k] for k in found] == names


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        if name in ("toxicity", "exact_dedup", "ngram_join"):
            assert 0.5 * before < out.count() <= before
        if name == "exact_dedup":
            assert out.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
        if name == "ngram_join":
            label, _ = linked([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id for r in out.collect()} == set(label.values())
        docs = out
    gapless(corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect())
