import hashlib
import random
import re

from sparkwright.llm import pii, queries

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(p[:-3].strip("0") or int(p[-3:]) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base_of(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]


def test_base_equals_plain_expressions_on_random_texts():
    rnd = random.Random(1)
    for alphabet in ("ab.@-+1 ", "0123456789 -.", "+()0123456789 .-x", "a@.%_9"):
        for _ in range(1500):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
            assert base_of(text) == brute(text), text


def test_query_on_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op2_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and sum(r.n_email for r in got) > 0
    for r in got:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in BASE]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_validators_and_context():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert "iban" in kinds("account GB82 WEST 1234 5698 7654 32 please")
    assert "iban" not in kinds("account GB82 WEST 1234 5698 7654 33 please")
    assert kinds("my SSN is 123-45-6789.") == ["national_id"] and kinds("part 123-45-6789.") == []
    near, far = pii.find("card 4539578763621486")[0], pii.find("4539578763621486")[0]
    assert near.score > far.score


def test_long_runs_of_zeros_in_each_part_of_an_address(spark):
    texts = []
    for n in (5000, 100_000):
        for part in range(4):
            for last, ok in (("7", True), ("256", False)):
                parts = ["1"] * 4
                parts[part] = "0" * n + last
                text = f"host {'.'.join(parts)} end"
                texts.append(text)
                assert [s.kind for s in pii.find(text)] == ["ip"] * ok, (n, part)
                assert base_of(text) == brute(text)
    assert [s.kind for s in pii.find("0" * 5000 + ".0.00.000")] == ["ip"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [len(r.spans) for r in pii.find_pii(docs).orderBy("doc_id").collect()] == [1, 0] * 8
    assert [r.text == "host [IP] end" for r in pii.redact(docs).orderBy("doc_id").collect()] == [True, False] * 8


IBANS = ["BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32", "ES91 2100 0418 4502 0005 1332"]


def test_account_numbers_end_where_their_country_says():
    for iban in IBANS:
        for shown in (iban, iban.replace(" ", "")):
            for after in (" BANK", " THEN more", ".", "", " 1234 5678", "\n"):
                text = f"Pay to {shown}{after}"
                assert [(s.kind, text[s.start : s.end]) for s in pii.find(text) if s.kind == "iban"] == [("iban", shown)], text
            for text in (f"Pay to {shown}X", f"Pay to {shown}7", f"Pay to x{shown}", "Pay to " + shown[:-1] + str((int(shown[-1]) + 1) % 10)):
                assert not [s for s in pii.find(text) if s.kind == "iban"], text


def brute_added(text):
    """Every start and end by plain rules: the spans of iban and national_id."""
    out, at = [], 0
    lengths = {c: int(n) for c, n in pii.IBAN_LENGTHS.items()}
    while at < len(text):
        n = lengths.get(text[at : at + 2])
        end, chars = at, ""
        while n and end < len(text) and len(chars) < n:
            if text[end] == " " and len(chars) % 4 == 0 and chars and text[end - 1] != " ":
                end += 1
            elif re.fullmatch("[A-Z0-9]", text[end]):
                chars, end = chars + text[end], end + 1
            else:
                break
        free = (at == 0 or not re.fullmatch("[A-Za-z0-9]", text[at - 1])) and not re.match("[A-Za-z0-9]", text[end : end + 1])
        moved = chars[4:] + chars[:4]
        if n and len(chars) == n and free and re.fullmatch("[0-9]{2}", chars[2:4]) and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in moved)) % 97 == 1:
            out.append(("iban", at, end))
            at = end
        else:
            at += 1
    for i in range(len(text) - 10):
        part = text[i : i + 11]
        alone = not re.match("[0-9-]", text[i + 11 : i + 12]) and (i == 0 or not re.match("[0-9-]", text[i - 1]))
        if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", part) and alone and part[:3] not in ("000", "666") and part[0] != "9" and part[4:6] != "00" and part[7:] != "0000":
            if any(re.search(r"\bssn\b|social security|national id", t, re.I) for t in (text[max(0, i - 48) : i], text[i + 11 : i + 59])):
                out.append(("national_id", i, i + 11))
    return out


def test_added_kinds_equal_plain_rules_on_random_texts():
    rnd = random.Random(12)
    found = 0
    for _ in range(4000):
        parts = [rnd.choice([*IBANS, *[i.replace(" ", "") for i in IBANS], "123-45-6789", "000-45-6789", "901-23-4567", "12-3", "SSN", "my national id", " ", " ", "A", "7", "BE", "DE89", ". ", "x" * 50]) for _ in range(rnd.randint(1, 7))]
        text = "".join(p + rnd.choice(["", " ", " "]) for p in parts)
        if rnd.random() < 0.3 and text:
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice("0A -b") + text[k + 1 :]
        want = brute_added(text)
        found += len(want)
        assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind not in pii.BASE] == want, text
    assert found > 2000


def test_edges_and_redaction(edge_docs, empty_docs):
    got = pii.find_pii(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.spans == [] for r in got if r.doc_id in (1, 2, 3, 4, 8))
    assert pii.find_pii(empty_docs).count() == 0
    clean = pii.redact(edge_docs)
    assert clean.columns == edge_docs.columns and clean.where("doc_id = 1").first().text is None
    assert pii.redacted("a b@c.de f +1 (555) 123-4567.", pii.find("a b@c.de f +1 (555) 123-4567.")) == "a [EMAIL] f [PHONE]."
