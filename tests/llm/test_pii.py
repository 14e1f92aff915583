import hashlib
import random
import re
import time

from postmatch.llm import pii
from tests.llm import odd_tables as samples

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = 0
            for k, c in enumerate(reversed(digits)):
                x = int(c) * (1 + k % 2)
                total += x - 9 * (x > 9)
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_base_kinds_follow_the_patterns():
    rng = random.Random(3)
    units = list("ab@.-_%+ 0123456789()\nü") + ["@x.yz", "4111 1111 1111 1111", "255.1.2.3", "+1 (555) 123-4567", "00"]
    for _ in range(20000):
        text = "".join(rng.choice(units) for _ in range(rng.randrange(1, 30)))
        assert pii.joined(pii.spans(text), pii.BASE) == plain(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "+1" + " " * 200_000, "1.2.3." * 30_000,
                 "+1" * 100_000, "a@" * 100_000, "1" * 5000 + ".1.2.3"):
        pii.spans(text)


def test_checksums_and_context_add_spans():
    def kinds(text):
        return [(s.kind, text[s.start:s.end]) for s in pii.spans(text)]

    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 bitte") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("GB83WEST12345698765432") == []  # wrong check digits
    assert kinds("routing number 021000021 today") == [("routing", "021000021")]
    assert kinds("number 021000021 today") == []  # no word near it
    assert kinds("his social security no 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("part 123-45-6789") == []


def test_redaction():
    assert pii.redacted("Mail a.b@c.de or +49 (30) 1234567.") == "Mail [EMAIL] or [PHONE]."
    assert pii.redacted("nothing here") == "nothing here"


def test_documents(spark):
    docs = samples.documents(spark)
    got = pii.pii_digests(docs).collect()
    want = sorted((repr(r[0]), hashlib.sha256(plain(r[1] or "").encode()).hexdigest()) for r in samples.rows())
    assert sorted((repr(r.doc_id), r.base_sha256) for r in got) == want
    assert pii.redact(docs).columns == docs.columns
    assert pii.pii_digests(samples.empty(spark)).count() == 0
    row = spark.createDataFrame([(1, "x a@b.cd 1.2.3.4", None, None, 5, *[None] * 5)], samples.SCHEMA)
    done = pii.redact(row).first()
    assert (done.text, done.n_chars) == ("x [EMAIL] [IP]", 14)
    found = pii.find_pii(row).first().found
    assert [(x.kind, x.start, x.end) for x in found] == [("email", 2, 8), ("ip", 9, 16)]


def test_further_spans_keep_off_all_base_spans():
    rng = random.Random(6)
    pieces = ["GB82 WEST 1234 5698 7654 32", "021000021", "routing number", "123-45-6789", "social security", "a@b.cd",
              "+49 30 1234567890", "4111 1111 1111 1111", "1.2.3.4", "x", ".", "GB82WEST12345698765432"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice((" ", " ", "", "-")) for _ in range(rng.randint(1, 12)))
        base = pii.base_spans(text)
        want = [(k, a, b) for k, a, b in pii.more_spans(text) if not any(a < y and x < b for _, x, y in base)]
        got = [(s.kind, s.start, s.end) for s in pii.spans(text) if s.kind not in pii.BASE]
        assert sorted(got) == sorted(x for x in want if pii.scored(text, *x).score >= pii.THRESHOLD)


def test_a_long_text_of_spans_takes_time_in_proportion():
    line = "mail a.b@c.de, call 10.0.0.1 or social security 123-45-6789 now\n"
    began = time.perf_counter()
    found = pii.spans(line * 20_000)
    assert len(found) == 60_000 and time.perf_counter() - began < 60
