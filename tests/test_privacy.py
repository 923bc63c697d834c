import base64
import json
from collections import Counter

import pytest

from ledgerloom.functions import privacy
from ledgerloom.plans import privacy_queries
from ledgerloom.plans.privacy_queries import PROBES


def token(*parts):
    return ".".join(base64.urlsafe_b64encode(json.dumps(p).encode()).decode().rstrip("=") if isinstance(p, dict) else p for p in parts)


@pytest.mark.parametrize("digit", sorted(PROBES))
def test_probes_and_second_pass(digit):
    text, clean, counts = PROBES[digit]
    if clean is None:
        assert privacy.check(text) == (None, Counter(), {counts})
        return
    found = Counter()
    assert privacy.redact(text, found) == clean
    assert tuple(found[c] for c in (privacy.PATH, privacy.CREDENTIALS, privacy.HOST)) == counts
    assert privacy.redact(clean, Counter()) == clean and privacy.check(text)[0] == clean


#: Token-shaped texts are put together here, never written out.
BLOCKED = {
    "private-key": ["-----BEGIN " + "PRIVATE KEY-----", "-----begin openssh " + "private key-----"],
    "authorization-header": ["Author" + "ization: Bearer abcd1234", '{\\"author' + 'ization\\": \\"Basic abcd', "proxy-author" + "ization = x"],
    "provider-token": ["g" + "hp_" + "a1" * 12, "x=A" + "KIA" + "Z" * 16 + " "],
    "jwt": ["t " + token({"alg": "none"}, {"a": 1}, "sig"), "t " + token({"alg": "HS"}, {"b": 2}, "")],
}


@pytest.mark.parametrize("category", sorted(BLOCKED))
def test_blocked(category):
    for text in BLOCKED[category]:
        assert category in privacy.check(text)[2] and privacy.check(text)[0] is None


@pytest.mark.parametrize("text", ["a.b.c", token({"alg": " "}, {}, "x"), token({"typ": "x"}, {}, "x"), "1.22.333", "authorization was asked for", "sk-short", "see 3/4 of a/b"])
def test_look_alikes_pass(text):
    assert privacy.check(text) == (text, Counter(), set())


def test_placeholders_from_the_input_are_not_trusted():
    assert privacy._open_credentials("https://user:pw@host/") and not privacy._open_credentials("https://<redacted:url-credentials>@host/")


@pytest.mark.parametrize("address,local", [("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("100.64.0.1", True), ("8.8.8.8", False), ("::1", True), ("fe80::1", True), ("2001:db8::1", False), ("192.0.2.1", False), ("::ffff:10.0.0.1", True), ("x", False), ("0.0.0.0", True)])
def test_addresses(address, local):
    assert privacy.local_address(address) == local


def test_frames(spark):
    rows = spark.createDataFrame([("b1", "cd ~/x/y"), ("b1", "ping 10.0.0.1 and 10.0.0.2"), ("b2", "cd ~/x/y"), ("b2", BLOCKED["provider-token"][0]), ("b3", None), ("b3", "")], "batch string, text string")
    got = {r.batch: (r.is_blocked, r.blocked_categories, [tuple(x) for x in r.redactions]) for r in privacy.batches(rows, ["batch"], "text").collect()}
    assert got == {"b1": (False, [], [("local-or-private-host", 2), ("local-path", 1)]), "b2": (True, ["provider-token"], []), "b3": (False, [], [])}
    assert privacy.batches(rows.filter("false"), ["batch"], "text").count() == 0


def test_queries_read_the_stored_texts(spark, tmp_path):
    header = BLOCKED["authorization-header"][0]
    texts = [("t0", "read /srv/a/b.txt\nthen ping 10.0.0.1"), ("t1", f"x {BLOCKED['provider-token'][0]} y"), ("tb", header), ("td", "see https://u:p@example.com/x and /etc/c/d"), ("tf", None)]
    spark.createDataFrame(texts, "text_id string, text string").write.parquet(str(tmp_path / "semantic_texts.parquet"))
    d = str(tmp_path)
    left = {r.text_id: (r.text, r.paths, r.credentials, r.hosts) for r in privacy_queries.prv_redacted(spark, d).collect()}
    path, credentials, host = (privacy.PLACEHOLDER[c] for c in (privacy.PATH, privacy.CREDENTIALS, privacy.HOST))
    assert left == {"t0": (f"read {path}\nthen ping {host}", 1, 0, 1), "t1": (None, 0, 0, 0), "tb": (None, 0, 0, 0), "td": (f"see https://{credentials}@example.com/x and {path}", 1, 1, 0), "tf": (None, 0, 0, 0)}
    stored = {r.category: r.n for r in privacy_queries.prv_postflight(spark, d).filter("not planted").collect()}
    assert stored == {privacy.PATH: 2, privacy.CREDENTIALS: 1, privacy.HOST: 1, "provider-token": 1, "authorization-header": 1}
    assert {(r.text_id, r.category) for r in privacy_queries.prv_blocked(spark, d).collect() if r.text_id.startswith("t") and r.text_id not in PROBES} == {("t1", "provider-token"), ("tb", "authorization-header")}


def test_all_fields_of_a_record_at_once(spark):
    rows = spark.createDataFrame([(["cd ~/x/y", None, "call", "call"],), ([BLOCKED["jwt"][0], "cd ~/x/y"],), ([],), (None,)], "f array<string>")
    got = [(r.r.texts, [tuple(x) for x in r.r.redactions], r.r.blocked) for r in rows.select(privacy.preflight_all("f").alias("r")).collect()]
    assert got == [(["cd <redacted:local-path>", None, "call", "call"], [("local-path", 1)], []), ([None, "cd <redacted:local-path>"], [("local-path", 1)], ["jwt"]), ([], [], []), ([], [], [])]
