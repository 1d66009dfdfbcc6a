"""The registered queries of operators 3 and 5: counts, digests and spans, by plain regular expressions."""

import hashlib
import random
import re

import pytest

from framewright.llm import queries

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def secrets(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


def luhn(digits):
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def personal(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda s: (kinds.index(s[0]), s[1]))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    key = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pieces = [
        lambda: f'{rng.choice(["password", "API_KEY", "Secret", "token", "apikey", "passwd"])}{rng.choice(["=", ": ", " = ", "\" : \"", "=="])}{key(rng.randrange(4, 40), "abcXYZ019+/_.=-")}',
        lambda: "AKIA" + key(rng.randrange(12, 20), "ABCXYZ0123456789"),
        lambda: key(rng.randrange(20, 45), "0123456789abcdef"),
        lambda: f"{key(5, 'ab.%+')}@{key(4, 'xyz-')}.{key(3, 'com')}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(rng.randrange(3, 6))),
        lambda: rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "123 456 789"]),
        lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(1000)}) {rng.randrange(10**6)}-{rng.randrange(100)}",
        lambda: rng.choice(["word", "é😀", "ſecret=abcdefgh", "the card 2024", "\n", "toKen: abcdefgh"]),
    ]
    docs = [(k, " ".join(rng.choice(pieces)() for _ in range(rng.randrange(1, 30)))) for k in range(150)]
    docs += [(900, None), (901, ""), (902, "x" * 50_000 + " token=" + "a1" * 200), (None, "secret: abcdef1 a@b.cc"), (5, docs[5][1])]
    path = tmp_path_factory.mktemp("digests")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), docs


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op3_secret_scan", secrets, ("assign", "access", "hex")), ("op5_personal_data", personal, ("email", "ip", "card", "phone"))])
def test_digests(spark, folder, name, plain, kinds):
    path, docs = folder
    want, written = [], {}
    for doc_id, text in docs:
        found = plain(text or "")
        spans = [f"{k}:{a}:{b}" for k, a, b in found]
        digest = hashlib.sha256(",".join(spans).encode()).hexdigest()
        want.append(str((doc_id, *(sum(k == kind for k, _, _ in found) for kind in kinds), digest)))
        written[doc_id, digest] = spans
    rows = queries.QUERIES[name](spark, path).collect()
    assert sorted(str((r["doc_id"], *(r[f"n_{k}"] for k in kinds), r["base_sha256"])) for r in rows) == sorted(want)
    for r in rows:
        spans = r["spans"].split(",") if r["spans"] else []
        base = [s for s in spans if s.split(":")[0] in kinds]
        assert base == written[r["doc_id"], r["base_sha256"]] and len(spans) == r["n_spans"]


def test_secret_query_finds_unlabelled_keys(spark, tmp_path):
    rng = random.Random(32)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    key = lambda: "".join(rng.choice(letters) for _ in range(40))
    vocabulary = [a + b for a in ("the", "lo", "me", "ka", "zu", "pri", "on", "ver") for b in ("na", "ta", "res", "lim", "bor", "tion", "sen", "dal")]
    # ordinary long tokens are names with numbers
    name = lambda: "".join(rng.choice(vocabulary) for _ in range(4)) + str(rng.randrange(2030))
    prose = lambda n: " ".join([*(rng.choice(vocabulary) for _ in range(n)), name()])
    planted = {k: key() for k in range(1000, 1030)}
    docs = [(k, f"{prose(40)} api_key = {key()} {prose(20)}") for k in range(200)] + [(k, f"{prose(40)} {v} {prose(20)}") for k, v in planted.items()] + [(k, prose(60)) for k in range(2000, 2200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(docs)
    found, wrong = set(), 0
    for r in queries.QUERIES["op3_secret_scan"](spark, str(tmp_path)).collect():
        for span in filter(None, r["spans"].split(",")):
            kind, a, b = span.split(":")
            if kind == "format":
                value = texts[r["doc_id"]][int(a) : int(b)]
                found.add(r["doc_id"]) if planted.get(r["doc_id"]) == value else None
                wrong += planted.get(r["doc_id"]) != value
    assert len(found) >= 27 and wrong == 0
