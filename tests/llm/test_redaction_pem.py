"""A private key goes with its body, not only its header."""

from tensorql.llm import secrets

BODY = "\n".join(["MIIEpAIBAAKCAQEA" + "Ab+/" * 12] * 400)
HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def test_no_body_is_left(spark):
    texts = [
        f"a\n{HEAD}\n{BODY}\n{END}\nb",
        f"a {HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{BODY}\n{END} b {HEAD}\n{BODY}\n{END} c",
        f"a {HEAD} only a header - in prose",
        f"a {HEAD}\n{BODY}\nMIIcut",
        f"a {HEAD} of prose, then {HEAD}\n{BODY}\n{END} b",
        f'"{HEAD}\\n{BODY[:64]}\\n{END}\\n"',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in sorted(secrets.redact(df).collect())]
    assert got == [
        "a\n[SECRET]\nb", "a [SECRET] b [SECRET] c", "a [SECRET] only a header - in prose", "a [SECRET]",
        "a [SECRET] of prose, then [SECRET] b", '"[SECRET]\\n"',
    ]
