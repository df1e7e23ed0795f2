"""Self-signed certificates made for the tests; their keys were thrown away."""

PEM = {
    "/certs/rsa.pem": """\
-----BEGIN CERTIFICATE-----
MIIDXjCCAkagAwIBAgIUDNI1q6gLPrbORKy5POniym7QWZUwDQYJKoZIhvcNAQEL
BQAwGjEYMBYGA1UEAwwPcnNhLmV4YW1wbGUub3JnMB4XDTI2MTEyNjEyMjExMloX
DTM2MTEyMzEyMjExMlowGjEYMBYGA1UEAwwPcnNhLmV4YW1wbGUub3JnMIIBIjAN
BgkqhkiG9w0BAQEFAAOCAQ8AMIIBCgKCAQEAx0AyXUg6ZxeZwcmoW3ztSwW8I955
aK/EC2kFnH83Uf9VL7jGzIMh0AD9renbuBdUCxxWu4enHPbGGS7CHBzFBbi5eRhZ
6G7kz/e3w8LAQYcbjuwVY5PA07AR9oGIq7AbO+CcBQXJtJRNJVkStAlIbDwK+Ces
3E9DZfqOZkxa9zDWDmeN0nsx3CgwOFaCe2Zy3/+B/OPrO4ntJ7OcYmWp81GVlpl+
foj1OEKBc56v3LBbbFXzbRUwKE1Pn5jPqXd5BlXi/XHR78KYJncZ+rDkwMwAnYzH
uSF9Q8SzB1Az7yFfNJVcafZKEgl7bALFNz8KtyJFDDv6qH2hjizI5MoMvQIDAQAB
o4GbMIGYMB0GA1UdDgQWBBQrXDb3Y4YLeiTlQYaposTqSG8i1DAfBgNVHSMEGDAW
gBQrXDb3Y4YLeiTlQYaposTqSG8i1DAPBgNVHRMBAf8EBTADAQH/MEUGA1UdEQQ+
MDyCDWEuZXhhbXBsZS5vcmeCDWIuZXhhbXBsZS5vcmeCDWMuZXhhbXBsZS5vcmeC
DWQuZXhhbXBsZS5vcmcwDQYJKoZIhvcNAQELBQADggEBAA948/DGLwD0UEvUKKA1
SRYztyFvqI/m4FnQLDVO0M+1MfHX7C9bWfhPZjxbdr6uE1loEF70uLCk+UW6S6hf
eG3k5D1ZRUKC2O9hYPIYno6rDIGWBl0puf8ChCt/Lt9uFQdAmHtXQHkmZd2MLq1d
z1CIm+QkWNe/rLWuf5gyBv2zzS0q1wq36IkKfbIlDaVezUBN/Q/TASl9nCeD+lF0
QifnVaS7puUb/WtnQTJOmmB+qn8qW/8/aXFANNtUXuVUM4Bf9OZyckRsp2bGvn7/
Zreg0L5gWeF1SOc0lgTYMp2MP2T5/yQ+bBweQVzKzaNaa/PV257kWml8764a+TSg
+JQ=
-----END CERTIFICATE-----
""",
    "/certs/ec.pem": """\
-----BEGIN CERTIFICATE-----
MIIBwTCCAUegAwIBAgIUO2imO4m0JQsI7t4A97tpAJk5bhYwCgYIKoZIzj0EAwIw
GTEXMBUGA1UEAwwOZWMuZXhhbXBsZS5vcmcwHhcNMjYxMTI2MTIyMTEyWhcNMjcx
MTI2MTIyMTEyWjAZMRcwFQYDVQQDDA5lYy5leGFtcGxlLm9yZzB2MBAGByqGSM49
AgEGBSuBBAAiA2IABD0fTB+DUtm1SjdN0LammBqu1KqS8SIGwwcV565K5bql0Z2/
ToXSBDxLVo0Q1bwNwk+jO+zTGB89WPDkyUB/Z1vRvoZ7h396LvVYaApO+cwIWxjf
WCtPRKf6SO+rXtoGqaNQME4wHQYDVR0OBBYEFP9yWpKxdPSYzGrd1SZoOyWxkrdH
MB8GA1UdIwQYMBaAFP9yWpKxdPSYzGrd1SZoOyWxkrdHMAwGA1UdEwEB/wQCMAAw
CgYIKoZIzj0EAwIDaAAwZQIxAK9Vpn5Z2i3ok4dq8hi3wqgoLKhaJtQBUmxcDsjG
dLBhaS3IqEnfEAATyShJ9r4quwIwep0w+YaPyZGmgXv4699hF9bnJAMeXYK86vn3
kOPD1BwsAleN1KjBDBxO2vL2DAxx
-----END CERTIFICATE-----
""",
    "/certs/ed.pem": """\
-----BEGIN CERTIFICATE-----
MIIBRjCB+aADAgECAhRHDLE5CH0Hu7mL8GIeuzGA14BakDAFBgMrZXAwGTEXMBUG
A1UEAwwOZWQuZXhhbXBsZS5vcmcwHhcNMjYxMTI2MTIyMTEyWhcNMjcxMTI2MTIy
MTEyWjAZMRcwFQYDVQQDDA5lZC5leGFtcGxlLm9yZzAqMAUGAytlcAMhAKabrvdb
x/Msqm5a6eKLGkY9UaoZ46QJpj2HZnjfzyjJo1MwUTAdBgNVHQ4EFgQUZ8mPRSZp
m8/raHBBb/EUbfZRBKEwHwYDVR0jBBgwFoAUZ8mPRSZpm8/raHBBb/EUbfZRBKEw
DwYDVR0TAQH/BAUwAwEB/zAFBgMrZXADQQANuYbApIgH2pPpJZ2MeCdUatxbtMjR
vLN0nmlP6//7XDB6ujwNyl4dwmcQprYuFubscM9vAtouqvalDb0blH4O
-----END CERTIFICATE-----
""",
}
