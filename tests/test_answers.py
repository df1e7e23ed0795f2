"""Queries over the sample files that SQL does not compute, against answers worked out by hand."""

import pytest

from cipherlake import catalog

GO = [
    ("/app/keys.go", 10, "goast-rsa-2048", "RSA-2048", 0, 0, 0, 2048),
    ("/app/keys.go", 11, "goast-md5", "MD5", 1, 1, 4, 0),
    ("/app/load.go", 16, "goast-rsa-4096", "RSA-4096", 1, 0, 0, 4096),
    ("/app/load.go", 17, "goast-ecdsa-p384", "ECDSA-P384", 0, 0, 1, 0),  # the key
    ("/app/load.go", 17, "goast-ecdsa-p384", "ECDSA-P384", 0, 0, 1, 0),  # the curve
    ("/app/load.go", 18, "goast-aes-128", "AES-128", 2, 1, 3, 128),
    ("/app/load.go", 20, "goast-aes-256", "AES-256", 3, 1, 3, 256),
    ("/app/load.go", 21, "goast-hmac-sha1", "HMAC-SHA1", 1, 1, 4, 0),
]
# one hop is 0.95 of the confidence; a literal starts from 0.90, a call from 0.95
TAINT = [
    ("/app/keys.go", 14, "RSA", 0, 0, 0, 0.95, "ecdsa.Sign"),
    ("/app/send.go", 5, "AES", 2, 1, 3, 0.9025, "cipher.NewGCM"),
    ("/app/send.go", 10, "DES", 0, 1, 3, 0.81225, "rsa.SignPSS"),
    ("/app/send.go", 10, "RSA", 0, 0, 0, 0.857375, "rsa.SignPSS"),
]
TLS = [("/app/load.go", 22, "TLS-1.1", 0), ("/app/load.go", 23, "TLS", 1)]


@pytest.mark.parametrize("name,rows", [("q_go_calls", GO), ("q_go_tls", TLS), ("q_taint", TAINT)])
def test_answers(spark, sf, name, rows):
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, sf).collect()) == sorted(rows)


def test_table_report_puts_the_worst_first(spark):
    from cipherlake.plans.relational import findings
    from cipherlake.sources.sinks import table_report

    order = [r.severity for r in table_report(findings(spark, "/root/testdata/sf0.001")).collect()]
    ranks = [("CRITICAL", "HIGH", "MEDIUM", "LOW").index(s) for s in order]
    assert ranks == sorted(ranks) and len(set(ranks)) > 1
