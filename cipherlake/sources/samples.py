"""Small source files written for the queries and tests, and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "/app/keys.go": ("go", 'package keys\n\nimport (\n\t"crypto/rsa"\n\t"crypto/md5"\n)\n\n// rsa.GenerateKey in a comment\nfunc newKey() {\n\tk, err := rsa.GenerateKey(rand.Reader, 2048)\n\th := md5.New()\n\tblock, err := aes.NewCipher(key)\n\tc := &tls.Config{MinVersion: tls.VersionTLS10}\n\tsig, err := ecdsa.Sign(rand.Reader, k, sum)\n\tuse(k, h, block, c, sig)\n}\n'),
    "/app/safe.go": ("go", "package safe\n\nfunc sum(b []byte) []byte {\n\th := sha256.New()\n\treturn h.Sum(b)\n}\n"),
    "/app/sign.py": ("python", 'import hashlib\nfrom cryptography.hazmat.primitives.asymmetric import rsa\n\n# hashlib.md5(b"x")\nkey = rsa.generate_private_key(public_exponent=65537, key_size=2048)\ndigest = hashlib.md5(data).hexdigest()\nlegacy = DES.new(secret, DES.MODE_ECB)\nname = "sha1"\nother = hashlib.new(name, data)\ncurve = ec.generate_private_key(ec.SECP384R1())\nbox = Fernet(token)\n'),
    "/app/Box.java": ("java", 'import javax.crypto.Cipher;\npublic class Box {\n  void run() throws Exception {\n    String algo = props.getProperty("DES");\n    Cipher c = Cipher.getInstance(algo);\n    // Cipher.getInstance("RC4")\n    KeyPairGenerator g = KeyPairGenerator.getInstance("RSA");\n    SecureRandom r = new SecureRandom();\n    g.initialize(2048);\n    MessageDigest d = MessageDigest.getInstance("SHA-1");\n    Signature s = Signature.getInstance("SHA256withRSA");\n    algo = other;\n    KeyPairGenerator e = KeyPairGenerator.getInstance("DSA");\n\n\n\n\n\n    e.initialize(1024);\n  }\n}\n'),
    "/app/web.js": ("javascript", "const crypto = require('crypto');\n// crypto.createHash('md5')\nconst h = crypto.createHash('md5').update(x);\nconst pair = crypto.generateKeyPairSync('rsa', {\n  publicExponent: 3,\n  modulusLength: 3072,\n});\nconst algo = 'sha1';\nconst g = crypto.createHash(algo);\nlet mode = 'des-cbc';\nconst c = crypto.createCipheriv(mode, key, iv);\nconst dh = crypto.createDiffieHellman(1024);\nconst k = new NodeRSA({b: 512});\nawait crypto.subtle.generateKey({name: 'ECDSA', namedCurve: 'P-384'}, true, use);\nawait crypto.subtle.generateKey({name: 'ECDH', namedCurve: 'P-256'}, true, use);\nnacl.box(m, n, pk, sk);\n"),
    "/etc/nginx.conf": ("config", "server {\n  # ssl_protocols TLSv1.1;\n  ssl_protocols TLSv1.1 TLSv1.2;\n  ssl_ciphers ECDHE-RSA-AES128-GCM-SHA256;\n}\n"),
    "/etc/sshd_config": ("config", "Port 22\nKexAlgorithms diffie-hellman-group14-sha256\nHostKey /etc/ssh/ssh_host_rsa_key\nPubkeyAcceptedAlgorithms ssh-rsa\n"),
    "/infra/main.tf": ("terraform", '# resource "aws_kms_key" "no" {\nresource "aws_kms_key" "main" {\n  description = "x"\n  customer_master_key_spec = "RSA_2048"\n  tags = {\n    a = "b"\n  }\n  key_spec = "ECC_NIST_P256"\n}\nkey_spec = "RSA_4096"\nresource "google_compute_ssl_policy" "p" {\n  profile = "MODERN"\n  min_tls_version = "TLS_1_0"\n}\nresource "tls_private_key" "t" {\n  algorithm = "RSA"\n  rsa_bits  = 4096\n}\nresource "aws_lb_listener" "l" {\n  ssl_policy = "ELBSecurityPolicy-2016-08"\n}\n'),
    "/infra/ingress.yaml": ("kubernetes", 'apiVersion: v1\n# ssl-protocols: SSLv3\nannotations:\n  nginx/ssl-ciphers: "RC4-SHA"\n  nginx/ssl-protocols: "TLSv1.1"\n  min-tls-version: "1.0"\nspec:\n  keyAlgorithm: rsa\n  keySize: 2048\n'),
}

DIFFS = {
    "c1": "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+k := rsa.GenerateKey(r, 2048)\n context\n",
    "c2": "@@ -1 +1 @@\n-h := md5.New()\n+h := sha256.New()\n",
    "c3": "@@\n+use ML-KEM instead of RSA\n-use RSA\n",
    "c4": "@@\n+provides nothing\n-describes nothing\n",
    "c5": "+++ b/rsa.go\n+desk\n",
    "c6": "-AES old\n+aes new\n",
    "c7": "+Kyber768 handshake\n",
    "c8": "",
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, lang, text) for p, (lang, text) in FILES.items()], "path string, language string, content string")


def diffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIFFS.items()), "sha string, diff string")

FILES["/app/load.go"] = (
    "go",
    'package app\n\nimport (\n\t"crypto/aes"\n\tec "crypto/ecdsa"\n\t"crypto/elliptic"\n\t"crypto/hmac"\n\t"crypto/rsa"\n\t"crypto/sha1"\n\t"crypto/tls"\n)\n\nvar shared = make([]byte, 16)\n\nfunc load(name string, n int) *rsa.PrivateKey {\n\tp, err := rsa.GenerateKey(rand.Reader, 4096)\n\te, _ := ec.GenerateKey(elliptic.P384(), rand.Reader)\n\tb, _ := aes.NewCipher(shared)\n\tlocal := make([]byte, 32)\n\tc, _ := aes.NewCipher(local)\n\tm := hmac.New(sha1.New, local)\n\told := &tls.Config{MinVersion: tls.VersionTLS11}\n\tplain := &tls.Config{ServerName: "x"}\n\tq := p\n\tsend(q, b)\n\tmode := "DES"\n\tsend(mode, c)\n\tkeep(e, m, old, plain, err)\n\treturn p\n}\n',
)
FILES["/app/send.go"] = (
    "go",
    "package app\n\nfunc send(key any, block any) {\n\tfinish(key)\n\tgcm, _ := cipher.NewGCM(block)\n\tuse(gcm)\n}\n\nfunc finish(k any) {\n\tsig, _ := rsa.SignPSS(rand.Reader, k, h, d, nil)\n\tuse(sig)\n}\n",
)
