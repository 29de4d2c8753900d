"""Secret spans against searching whole texts with the base expressions."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tiffin.llm.queries import LLM_QUERIES
from tiffin.llm.secret_scan import BASE62, automaton, scan, secrets_in

ORDER = ["assign", "access", "hex"]
PLAIN = {
    "assign": (
        re.compile(
            r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
            r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        lambda m: len(m[2]) >= 8,
    ),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base(text):
    found = [(k, *m.span()) for k, (p, ok) in PLAIN.items() for m in p.finditer(text or "") if ok(m)]
    return sorted(found, key=lambda f: (f[1], ORDER.index(f[0])))


def base_found(text):
    return [f for f in secrets_in(text, automaton()) if f[0] in ORDER]


PIECES = st.sampled_from(
    ["password", "PASSWD", "toKen", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "=", "AKIA", "abc", "DEF123", "0123456789abcdef" * 2,
     "ſecret=", "İ", "K", "é", "\n", "aaaaaaaa", "-", "x=y.z/"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_base_spans(text):
    assert base_found(text) == base(text)


def token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return prefix + body + digits.rjust(6, "0")


def test_checksums():
    good = token("ghp_", "a1B2" * 7 + "zz")
    assert ("github", 3, 43) in secrets_in(f"is {good}.", automaton())
    bad = good[:-1] + ("1" if good[-1] != "1" else "2")
    assert not [f for f in secrets_in(f"is {bad}.", automaton()) if f[0] == "github"]
    assert ("npm", 0, 40) in secrets_in(token("npm_", "Q" * 30), automaton())


def test_odd_rows(documents):
    docs = documents((1, None), (2, ""), (3, "token=abcdefgh"), (3, "token=abcdefgh"), (None, "x" * 200_000), extra="spans kind")
    found = {(r.doc_id, tuple((s.kind, s.begin, s.stop) for s in r.spans)) for r in scan(docs).collect()}
    assert found == {(1, ()), (2, ()), (3, (("assign", 0, 14),)), (None, ())}
    assert scan(docs.limit(0)).count() == 0


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = LLM_QUERIES["op8_secret_scans"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[0] == k for f in want) for k in ORDER)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
