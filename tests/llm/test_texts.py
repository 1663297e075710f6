"""Fingerprints, personal data, quality rules, secrets and classifiers."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lathe.llm import fingerprint, nets, pii, quality, secrets, sitebayes, toxicity
from lathe.llm.batches import read_table
from tests.llm.conftest import HARD, SF

WORDS = re.compile("[^\x20\x09-\x0d]+")


# -- fingerprints


def _brute_hash(text):
    p = int(fingerprint.PRIME)
    return sum((ord(c) + 1) * pow(fingerprint.BASE, k, p) for k, c in enumerate(text)) % p


def test_prefix_hashes():
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choices("ab é🙂", k=rng.randint(0, 60)))
        own = fingerprint.PrefixHash(text)
        assert own.prefix[-1] == _brute_hash(text)
        i = rng.randint(0, len(text))
        j = rng.randint(i, len(text))
        assert own.span(i, j) == _brute_hash(text[i:j])
        other = "".join(rng.choices("ab", k=40))
        a, b, n = rng.randint(0, len(text)), rng.randint(0, 40), 0
        while a + n < len(text) and b + n < 40 and text[a + n] == other[b + n]:
            n += 1
        assert own.extension(a, fingerprint.PrefixHash(other), b) == n


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = "".join(random.Random(1).choices("abcdefgh ", k=5000))
    whole = fingerprint.PrefixHash(text)
    monkeypatch.setattr(fingerprint, "BLOCK", 700)
    parts = fingerprint.PrefixHash(text)
    assert np.array_equal(whole.prefix, parts.prefix) and whole.whole == parts.whole


def test_repeats_count_over_the_whole_text(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("etaoins", k=4)) for _ in range(60)) * 40
    whole, doubled = fingerprint.fingerprint(text), fingerprint.fingerprint(text * 2)
    assert 0.3 < fingerprint.likeness(whole, doubled) < 0.7
    monkeypatch.setattr(fingerprint, "BLOCK", 700)
    assert (fingerprint.fingerprint(text), fingerprint.fingerprint(text * 2)) == (whole, doubled)


def test_likeness():
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choices("etaoins", k=5)) for _ in range(n))
    for _ in range(20):
        a, b = make(200), make(200)
        fa, fb = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
        fe = fingerprint.fingerprint(fingerprint.edited(a, b))
        assert fingerprint.likeness(fa, fa) == 1 and fingerprint.likeness(fa, fb) < 0.1 < 0.35 < fingerprint.likeness(fa, fe) < 0.9
    assert fingerprint.likeness(fingerprint.fingerprint(""), fa) == 0


def _check_neighbours(found, rows):
    assert len(found) == len(rows)
    for k, r in enumerate(found):
        text, following = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        changed = fingerprint.edited(text, following)
        assert (r["doc_id"], r["n_chars"]) == (rows[k][0], len(text))
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.fingerprint(text)
        assert r["edited_fingerprint"] == fingerprint.fingerprint(changed)
        assert r["near_next"] == fingerprint.likeness(r["fingerprint"], fingerprint.fingerprint(following))


def test_neighbours(spark, hard, empty, rows):
    _check_neighbours(sorted(fingerprint.op1_fingerprint(spark, SF).collect(), key=lambda r: r["doc_id"]), rows)
    found = fingerprint.compare_neighbours(hard).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in HARD)
    equal = {r["fingerprint"] for r in found if r["n_chars"] == 27}
    assert len(equal) == 1
    assert fingerprint.compare_neighbours(empty).collect() == []
    single = spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprint.compare_neighbours(single).collect()] == [1.0]
    assert fingerprint.fingerprint_texts(hard).count() == len(HARD)


# -- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile("[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    spans += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_personal_spans():
    rng = random.Random(2)
    bits = "a|b.|@|@x|x.y|1|.|0|255|256|12|0000|4111111111111111| |-|+|(|)|+1|é|%|\n|12345".split("|")
    for _ in range(8000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 16)))
        assert pii.base_spans(text) == brute_personal(text), text


def test_network_adds_spans():
    net = pii.trained()
    inputs, tags = pii.labelled_windows(300, 99)
    rows = [(x[x > 0].astype(np.uint8), y[x > 0]) for x, y in zip(inputs, tags)]
    right = [(net.best([net.emissions([x])])[0][0] == y) for x, y in rows if len(x)]
    assert np.concatenate(right).mean() > 0.93
    cases = {
        "call me at (415) 555-0199 today": ["(415) 555-0199"],
        "mail bob @ example.org now": ["bob @ example.org"],
        "nothing of 2021-03-04 at 12:30, or 1,234,567 pieces": [],
    }
    for text, want in cases.items():
        spans = pii.all_spans(pa.array([text]), net)[0]
        assert [text[a:b] for a, b, _ in spans] == want


def test_long_spans_at_every_offset():
    net = pii.trained()
    before = "the other pieces of prose that stand before it are of no account "
    for span in ("firstname.lastname @ department.example.org", "john.doe.longer.name @ mail.department.university.example.com"):
        texts = [before[-40 - k :] + span + " and so on " * 9 for k in range(pii.STRIDE // 2 + 8)]
        texts += ["x" * k + " " + before + span for k in range(pii.STRIDE)]
        for text, spans in zip(texts, pii.all_spans(pa.array(texts), net)):
            assert [text[a:b] for a, b, _ in spans] == [span], text


def test_spelled_addresses_without_digits():
    """Texts without a digit or an at sign are read too."""
    net = pii.trained()
    spans = ["jane.doe [at] example [dot] com", "john at example dot org", "mary (at) company.net", "a dot b at c dot d dot edu"]
    spans += ["bob[at]home[dot]org", "J_R AT EXAMPLE DOT COM"]
    before = "the other pieces of prose that stand before it are of no account; "
    for span in spans:
        texts = ["é" * k + before + span + ", and so on" for k in range(pii.STRIDE)]
        for text, found in zip(texts, pii.all_spans(pa.array(texts), net)):
            assert [(text[a:b], kind) for a, b, kind in found] == [(span, "email")], text
    calm = ["look at the data at hand. Then go", "meet at noon at www.example.org", "at dot", "", " at ", "[at] x [dot] y", "that dot com"]
    assert pii.all_spans(pa.array(calm), net) == [[] for _ in calm]
    # The network alone finds them as well where the marks are in brackets.
    text = before + spans[0] + ", and so on"
    emit = net.emissions([pii.inputs_of(text)])
    own = [s for (a, _), (t, m) in zip(net.runs(emit), net.best([emit[a:b] for a, b in net.runs(emit)])) for s in pii.spans_in(t, m, a)]
    assert spans[0] in [text[a:b] for a, b, _, _ in own]


def test_runs_hold_the_best_path():
    """Decoding the runs alone gives the tags of one decoding of the whole text."""
    net, rng = pii.trained(), np.random.default_rng(3)
    trans = net.p["trans"] + net.barred
    for n in [1, 2, 40, 700] * 10:
        emit = (rng.standard_normal((n, net.TAGS)) * 2).astype(np.float32)
        emit[:, 1::2] -= rng.choice([2, 6])
        emit[:, 0] += rng.choice([0, 1])
        whole = emit[:, None].astype(np.float64)
        whole[0] += trans[0]
        whole[-1] += trans[:, 0]
        want = pii.viterbi(whole, trans.astype(np.float64))[0][:, 0]
        got, runs = np.zeros(n, np.int64), net.runs(emit)
        for (a, b), (tags, _) in zip(runs, net.best([emit[a:b] for a, b in runs])):
            got[a:b] = tags
        assert np.array_equal(got, want)


def test_runs_of_joined_texts():
    """Texts decoded together have the runs they have alone; ``least`` leaves out only runs without a wide margin."""
    net, rng = pii.trained(), np.random.default_rng(4)
    for _ in range(40):
        texts = [(rng.standard_normal((n, net.TAGS)) * 2).astype(np.float32) for n in rng.integers(1, 60, 5)]
        for emit in texts:
            emit[:, 1::2] -= rng.choice([2, 4])
        begins = np.cumsum([0, *map(len, texts[:-1])])
        alone = [(a + k, b + k) for k, emit in zip(begins.tolist(), texts) for a, b in net.runs(emit)]
        assert net.runs(np.concatenate(texts), begins) == alone
        few = [(a + k, b + k) for k, emit in zip(begins.tolist(), texts) for a, b in net.runs(emit, least=4.0)]
        assert set(few) <= set(alone) and net.runs(np.concatenate(texts), begins, 4.0) == few
        for (a, b), (tags, margins) in zip(alone, net.best([np.concatenate(texts)[a:b] for a, b in alone])):
            assert (a, b) in few or all(m < 4 for *_, m in pii.spans_in(tags, margins, 0))


def test_windows_give_the_spans_of_one_decoding(monkeypatch, rows):
    """Overlapping windows against one window over the whole text."""
    net = pii.trained()
    rng = random.Random(8)
    made = [" ".join(rng.choice([pii._word, pii._word, pii._word, pii._other, pii._phone, pii._email])(rng) for _ in range(400)) for _ in range(6)]
    texts = [t for _, t in rows if t][:60] + made
    parts = pii.all_spans(pa.array(texts), net)
    monkeypatch.setattr(pii, "STRIDE", 1 << 22)
    whole = pii.all_spans(pa.array(texts), net)
    same = sum(len(set(a) & set(b)) for a, b in zip(parts, whole))
    assert same > 300 and same >= 0.99 * max(sum(map(len, parts)), sum(map(len, whole)))


def test_decoding_in_full_small_products(monkeypatch, rows):
    """Windows are decoded by about BATCH, in products that OpenBLAS takes as they are; what can't be kept has no search."""
    net, counts, searched = pii.trained(), [], []
    scores, best = pii.lstm_scores, pii.SpanNet.best
    monkeypatch.setattr(pii, "lstm_scores", lambda x, *a, **k: (counts.append(x.shape[-1]), scores(x, *a, **k))[1])
    monkeypatch.setattr(pii.SpanNet, "best", lambda self, runs: (searched.extend(runs), best(self, runs))[1])
    texts = [t for _, t in rows if t]
    found = pii.all_spans(pa.array(texts), net)
    whole = sum(-(-len(t) // pii.STRIDE) for t in texts)
    products = net.ahead[0].size
    assert sum(counts) == 2 * whole and max(counts) * products <= 10**6 and np.median(counts) >= 0.9 * pii.BATCH
    # Every run before: a search for each, and the same spans.
    few = len(searched)
    monkeypatch.setattr(pii, "bearing", lambda text: True)
    assert pii.all_spans(pa.array(texts), net) == found and 3 * few < len(searched) - few


def test_bearing_texts():
    rng = random.Random(6)
    bits = "at|AT|dot|.|@|cat|b|Bo|1|23|4567|é|_| |-|(|[|\n|İ".split("|")
    for _ in range(8000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 24)))
        a, b = sorted(rng.choices(range(len(text) + 1), k=2))
        assert pii.bearing(text) or not any(pii.plausible(text[a:b], kind) for kind in pii.KINDS if a < b), text[a:b]


def test_scores_of_sequences_of_many_lengths():
    """Both directions over sequences decoded together, against each alone."""
    rng = np.random.default_rng(5)
    e, h, tags = 3, 4, 5
    w, u, b, out = (rng.standard_normal(n).astype(np.float32) for n in ((e, 4 * h), (h, 4 * h), (4 * h,), (h, tags)))
    for count in (1, 2, 9, 60):
        sizes = np.sort(rng.integers(1, 40, count))[::-1]
        x = rng.standard_normal((e, sizes[0], count)).astype(np.float32)
        active = [int((sizes > t).sum()) for t in range(sizes[0])]
        got = np.zeros((2, sizes[0], tags, count), np.float32)
        nets.lstm_scores(x, active, nets.stacked(w, u, b), out, got[0])
        got[1] = got[0]
        nets.lstm_scores(x, active, nets.stacked(w, u, b), out, got[1], back=True)
        for k, size in enumerate(sizes.tolist()):
            z = (x[:, :size, k].T @ w + b)[:, None]
            ahead, behind = nets.lstm_forward(z, u)[:, 0] @ out, nets.lstm_forward(z[::-1], u)[::-1, 0] @ out
            assert np.allclose(got[0, :size, :, k], ahead, atol=1e-4) and np.allclose(got[1, :size, :, k], ahead + behind, atol=1e-4)


def test_personal_query(spark, hard, empty, rows):
    found = {r["doc_id"]: r for r in pii.op2_pii(spark, SF).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = brute_personal(text)
        shown = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert found[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(shown.split(",")) <= set(found[i]["spans"].split(",")) or not base
    assert pii.find_personal(hard).count() == len(HARD) and pii.find_personal(empty).collect() == []


def test_redaction(spark, hard):
    assert pii.redacted("a 1 b", [(2, 3, "ip")]) == "a [IP] b"
    df = spark.createDataFrame([(1, "x a@b.cc y", 10), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "x [EMAIL] y", 11), (2, None, 0)]
    assert pii.redact(hard).schema == hard.schema and pii.redact(hard).count() == len(HARD)


# -- quality rules


def brute_quality(text):
    words = WORDS.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    twice = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(twice)


def test_quality_counts(spark, hard, empty, rows):
    rng = random.Random(1)
    texts = [t for _, t in rows] + [t or "" for _, t in HARD] + ["".join(rng.choices("ab \n", k=60)) for _ in range(200)]
    found = quality.measure(pa.array(texts), quality.default_vocabulary())
    for k, text in enumerate(texts):
        assert tuple(int(found[n][k]) for n in quality.LONGS) == brute_quality(text)
    pieces, _ = quality.load_pieces(quality.default_vocabulary())
    for k in range(0, len(rows), 9):
        ids = pieces.encode(" ".join(WORDS.findall(texts[k])))
        share = np.array(list(Counter(ids).values())) / max(1, len(ids))
        assert found["n_tokens"][k] == len(ids)
        assert found["entropy"][k] == pytest.approx(float(-(share * np.log2(share)).sum()), abs=1e-6)
    assert quality.assess(hard).count() == len(HARD) and quality.assess(empty).collect() == []
    assert quality.keep_good(hard).schema == hard.schema


def test_quality_verdicts(spark):
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    for r in quality.op3_quality(spark, SF).collect():
        if r["base_failed"]:
            assert not r["kept"]
        elif labels.get(r["doc_id"]) == 1:
            assert r["kept"]


def test_short_texts_have_bands():
    """Junk is rejected and prose kept on either side of the border between short and other texts."""
    for words in (10, 14, 31, 33, 60):
        junk = " ".join(["###", "$$$", "&&&", "***"][k % 4] for k in range(words))
        prose = " ".join("the old town lies by a river that runs down from high hills where sheep graze in summer and snow stays "
                         "late most years so farmers who live there keep small barns full of hay for cattle until spring comes "
                         "with rain warm wind green fields long light days bright song birds new leaves many more".split()[:words])
        found = quality.measure(pa.array([junk, prose]), quality.default_vocabulary())
        found["n_repeat_words"][:] = 0
        assert quality.verdicts(found, ["en", "en"], quality.BANDS)[1].tolist() == [False, True], words


# -- secrets


def brute_secrets(text):
    assign = re.compile(
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
        "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    spans = [(*m.span(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def _scan(texts):
    array = pa.array(texts, pa.string())
    lowered = pc.ascii_lower(array).to_pylist()
    return [secrets.scan(t, low, s) for t, low, s in zip(texts, lowered, secrets.hex_suspects(array).tolist())]


def test_secrets():
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "toKen", "ſecret", ":", "=", " ", "'", '"', "abc"]
    bits += ["deadbeef0123", "deadbeef01234567deadbeef", "AKIA", "ABCDEFGH12345678", "é", "xyz", "\n", "0", "a", "f" * 23, "ß"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(8000)]
    for text, found in zip(texts, _scan(texts)):
        assert [s for s in found if s[2] in secrets.BASE_KINDS] == brute_secrets(text)


def test_checksums():
    body = "".join(random.Random(1).choices(secrets.BASE62, k=30))
    good = "ghp_" + body + secrets.checksum62(body)
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    npm = "npm_" + body + secrets.checksum62(body)
    key = "-----BEGIN RSA PRIVATE KEY-----\nQUJD\nREVG\n-----END RSA PRIVATE KEY-----"
    assert [[s[2] for s in f] for f in _scan([f"x {good} y", f"x {bad} y", npm, key])] == [["github"], [], ["npm"], ["pem"]]


def test_private_keys_of_any_length():
    ends = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,\n  0AB1\n\n"
    bodies = ["QUJD\n" * n for n in (1, 200, 201, 5000)] + ["QUJD" * 30 + "\n", head + "QUJD\n", "QUJD\\nQUJD\\n", "QUJD"]
    for body in bodies:
        text = f"x {ends[0]}{body}{ends[1]} y"
        assert [s for s in _scan([text])[0] if s[2] == "pem"] == [(2, len(text) - 2, "pem")], body[:40]
    for bad in ["QUJ\n", "", "QU-JD\n", "no base64: at all\n"]:
        assert _scan([f"{ends[0]}{bad}{ends[1]}"]) == [[]]
    assert _scan([ends[0] + "QUJD\n" + "-----END EC PRIVATE KEY-----", ends[0] * 3000]) == [[], []]


def test_secret_query(spark, hard, empty, rows):
    found = {r["doc_id"]: r for r in secrets.op7_secrets(spark, SF).collect()}
    for i, text in rows:
        base = brute_secrets(text)
        shown = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert found[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(s[2] == k for s in base) for k in secrets.BASE_KINDS]
    assert secrets.find_secrets(hard).count() == len(HARD) and secrets.find_secrets(empty).collect() == []


# -- classifiers

BAD = ["idiot", "moron", "scum"]


def _toxic_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(rng.choices(["th", "er", "an", "on", "re"], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 150))]
        if toxic := k % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_toxicity_learns():
    train, test = _toxic_rows(600, 1), _toxic_rows(300, 2)
    net = toxicity.ToxicNet([t for t, _ in train], np.array([y for _, y in train]))
    score = net.score(pa.array([t for t, _ in test]))
    labels = np.array([y for _, y in test])
    assert ((score >= toxicity.THRESHOLD) == labels).mean() > 0.97
    # One bad window in a long text is enough, wherever it stands.
    calm = " ".join(t for t, y in test if not y)
    assert net.score(pa.array([calm]))[0] < 0.3 <= net.score(pa.array([f"{calm} idiot scum moron {calm}"]))[0]


def test_toxicity_query(spark, hard, empty):
    rows = toxicity.op10_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    net = toxicity.ToxicNet([], np.zeros(0, np.int64))
    assert {r["score"] for r in toxicity.score_texts(hard, net).collect()} == {net.base}
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    net = toxicity.train(hard, labels)
    assert toxicity.score_texts(hard, net).count() == len(HARD) and toxicity.keep_clean(empty, net).collect() == []


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    texts, _ = toxicity.training_rows(docs, labels, toxicity.Training())
    assert sorted(texts) == sorted(f"text number {k}" for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2)


def test_site_bayes(spark, hard, empty):
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    rows = sitebayes.op5_site_bayes(spark, SF).collect()
    judged = [(r["kept"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert np.mean([k == (y == 1) for k, y in judged]) > 0.95
    nothing = sitebayes.Evidence([], np.zeros(0))
    assert sitebayes.classify(hard, nothing).count() == len(HARD) and sitebayes.classify(empty, nothing).collect() == []


def test_sparse_sites_are_shrunk(spark):
    good, bad = "plain words of prose here. " * 8, "### $$$ &&& *** ### " * 8
    rows = [(k, good if k % 10 else bad, "big") for k in range(100)] + [(200, bad, "tiny"), (201, bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = sitebayes.Evidence([good, bad] * 20, np.array([1.0, 0.0] * 20))
    found = {r["doc_id"]: r for r in sitebayes.classify(df, model, path_col=None).collect()}
    assert found[1]["kept"] and not found[0]["kept"]
    # A site with one document, which is left out of its own site's rate, has the global rate.
    assert abs(found[200]["path_rate"] - found[1]["host_rate"]) < 0.15
