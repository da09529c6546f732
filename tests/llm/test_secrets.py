import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tracewright.llm.queries import QUERIES
from tracewright.llm.secrets import base_spans, endpoints, linked_spans, scan_secrets, weak_parts

BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24),
}
WEAK = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab"


def base(text):
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def rows_of(spark, docs_of, texts, reach=None):
    return {r[0]: r for r in scan_secrets(docs_of(texts).withColumn("spans", F.lit("clash")), reach).collect()}


def test_base_spans_against_brute_force(spark, docs_of):
    rng = random.Random(2)
    parts = ["password", "PassWd", "token: password = abcdef", "api_key", "APIKEY='", "=", ": ", '"', "secret=abcde", "AKIA", "AKIA" + "Q" * 16, "0123456789abcdef" * 2,
             "é", "\n", "K", "ſecret=abcdefgh", " ", "abcdefabcdefabcdefabcdef", "x", "ToKeN"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)), "deadbeef" * 4000]
    got = rows_of(spark, docs_of, texts)
    for i, text in enumerate(texts):
        want = base(text)
        counts = [sum(x.startswith(k) for x in want) for k in BASE]
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == counts, text
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(got[i]["spans"].split(",")) | {""} or not want


def test_links(spark, docs_of):
    access, place = "AKIA" + "Z" * 16, "s3.eu-west-1.amazonaws.com"
    texts = [
        f"{WEAK}", f"{access} and {WEAK}", f"{place}", f"{place} with {WEAK}", f"{access}\n\n{WEAK}", f"{access} {'x ' * 400}{WEAK}", f"{place} password=hunter22",
        f"AKIAZZZZZZZZZZ {WEAK}", f"AKIAZZZZZZZZZZ {place}", f"é{access} {WEAK} {access}",
    ]
    got = {i: [x.split(":")[0] for x in r["spans"].split(",") if x] for i, r in rows_of(spark, docs_of, texts, 400).items()}
    assert got == {
        0: [], 1: ["access", "weak_secret"], 2: [], 3: ["endpoint", "weak_secret"], 4: ["access"], 5: ["access"], 6: ["endpoint", "assign"],
        7: ["weak_access", "weak_secret"], 8: [], 9: ["access", "weak_secret", "access"],
    }
    assert scan_secrets(docs_of([])).count() == 0


def test_links_of_assigned_parts(spark, docs_of):
    access, place = "AKIA" + "Z" * 16, "s3.eu-west-1.amazonaws.com"
    texts = [
        f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={WEAK}", f"export AWS_ACCESS_KEY_ID='{access}'\nexport AWS_SECRET_ACCESS_KEY='{WEAK}'",
        f'{{"AccessKeyId": "{access}", "SecretAccessKey": "{WEAK}"}}', f"host={place}\nkey={WEAK}", f"key={WEAK}", f"key={WEAK}= {access}", f"key=x{WEAK} {access}",
    ]
    got = {i: [x.split(":")[0] for x in r["spans"].split(",") if x] for i, r in rows_of(spark, docs_of, texts).items()}
    assert got == {
        0: ["access", "weak_secret"], 1: ["access", "weak_secret"], 2: ["access", "weak_secret"], 3: ["endpoint", "weak_secret"], 4: [], 5: ["access"], 6: ["access"],
    }


def test_query_links_whole_paragraphs(spark, docs_of, tmp_path):
    access, place, far = "AKIA" + "Z" * 16, "s3.eu-west-1.amazonaws.com", "x " * 900
    texts = [f"{access} {far}{WEAK}", f"{WEAK}\n{far}\n{place}", f"{access} {far}\n\n{WEAK}", f"AKIAZZZZZZZZZZ {far}password=hunter22", f"{WEAK} {far}"]
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",") if x] for r in QUERIES["op7_secret_links"](spark, str(tmp_path)).collect()}
    assert got == {0: ["access", "weak_secret"], 1: ["weak_secret", "endpoint"], 2: ["access"], 3: ["weak_access", "assign"], 4: []}


PLAIN_ENDPOINT = re.compile(r"\bhttps?://[A-Za-z0-9.-]+(?::\d+)?|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)\b", re.ASCII)


def test_endpoints_equal_a_plain_pattern():
    rng = random.Random(12)
    parts = ["a", "-", ".", "..", "X", "_", " ", "s3", "é", ":8", "/", "https://", "http://x", "amazonaws.com", ".amazonaws.com", ".core.windows.net", ".googleapis.com", "b.c", "com"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert sorted(endpoints(text)) == [m.span() for m in PLAIN_ENDPOINT.finditer(text)], text


def test_links_against_brute_force():
    rng = random.Random(13)
    parts = [WEAK, "AKIA" + "Z" * 16, "AKIAZZZZZZZZZZ", "s3.amazonaws.com", "password=hunter22", "\n\n", "\n \n", "\n", " ", "x " * 30, "https://h.example:80/p", "AccountName=abc1", "A1b" * 28 + "Ab=="]
    complement = {"weak_secret": {"access", "weak_access", "endpoint"}, "weak_access": {"weak_secret", "assign"}, "endpoint": {"weak_secret", "assign"}}
    linked = 0
    for k in range(1500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        reach = [None, 5, 60][k % 3]
        base, weak = base_spans(text), weak_parts(text)
        ends = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
        scope = lambda x: sum(e < x for e in ends)
        want = {w for w in weak if any(
            o[1] in complement[w[1]] and scope(o[0]) == scope(w[0]) and (reach is None or (o[0] <= w[2] + reach and o[2] >= w[0] - reach)) for o in base + weak if o != w)}
        got = linked_spans(text, base, reach)
        assert set(got) == want and len(got) == len(want), (text, reach)
        linked += len(got)
    assert linked > 1000


def test_parts_of_vendors(spark, docs_of):
    key = ("Q1w" * 29)[:86] + "=="
    client = "123456789012-" + "x1z9" * 8 + ".apps.googleusercontent.com"
    texts = [
        f"DefaultEndpointsProtocol=https;AccountName=store1;AccountKey={key};EndpointSuffix=x.core.windows.net", f"AccountName=store1;AccountKey={key}", f"AccountKey={key}",
        f"id {client}\nkey GOCSPX-{'aB3_' * 7}", client, f"GOCSPX-{'aB3_' * 7}"]
    got = {i: [x.split(":")[0] for x in r["spans"].split(",") if x] for i, r in rows_of(spark, docs_of, texts).items()}
    assert got == {0: ["weak_access", "weak_secret", "endpoint"], 1: ["weak_access", "weak_secret"], 2: [], 3: ["weak_access", "weak_secret"], 4: [], 5: []}


def test_long_texts_take_linear_time():
    for piece in ("a.", "a-", "AKIA", "a.amazonaws.com.", "token ", "Ab1/", "\n ", "1", "http://"):
        text = piece * (1_000_000 // len(piece)) + " x.com"
        start = time.process_time()
        linked_spans(text, base_spans(text))
        assert time.process_time() - start < 20, piece
