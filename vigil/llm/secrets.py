"""Secret scans (operator 4).

Patterns propose spans; what a pattern alone can't tell is confirmed by structure before it is added:
base64 (of either alphabet) and hex candidates are decoded and read as keys (DER with nested lengths that add up and the
elements of a kind of key, OpenSSH files whose strings fill them, SSH wire strings), and signed tokens must have a JSON header that names its algorithm.

Kinds, in this order where spans begin at one place:

* base: ``assign`` (a value given to a name such as password), ``access`` (access key ids), ``hex``
* confirmed: ``jwt`` (signed token), ``pem`` (private key block), ``der`` (key in base64 or hex),
  ``ssh`` (key in SSH's wire format)

Spans count code points, the end is exclusive. A null or empty text has none. All matching is linear
in the text: candidates are found by their separators or literal beginnings, so long texts are read as a
whole. Spans of different kinds may overlap and are all kept; rows are scanned one by one, repeated or not.
The column that is added replaces one of its name; all other columns stay.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
BASE = 3
RANK = {k: i for i, k in enumerate(KINDS)}

_SEPARATOR = re.compile("[:=]")
_NAME = re.compile("(?ai:password|passwd|secret|token|api_?key)$")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_URL64 = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
#: For a quick look whether a text has a long run at all: hex digits become "h", other base64 "b", what only urls' base64 has "-".
_CLASS = bytes(104 if chr(i) in "0123456789abcdef" else 98 if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/" else 45 if chr(i) in "-_" else 32 for i in range(256))
_ONE_CLASS = bytes(98 if x != 32 else 32 for x in _CLASS)
#: Names of key types in SSH's wire format.
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
#: Algorithm names of signed tokens.
JWT_ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none"}


def assignments(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the assignment pattern with values of 6 characters or more.

    Each match has one separator, so separators are looked for and the name is read backwards from them.
    """
    out, done = [], 0
    for sep in _SEPARATOR.finditer(text):
        at = sep.start()
        if at < done:
            continue
        i = at
        while i > done and text[i - 1] == " ":
            i -= 1
        if i > done and text[i - 1] in "\"'":
            i -= 1
        name = _NAME.search(text, max(done, i - 8), i)
        if name and (m := _ASSIGN.match(text, name.start())):
            done = m.end()
            if m.end(1) - m.start(1) >= 6:
                out.append(m.span())
    return out


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the content of the DER element whose length bytes begin at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    at += 1
    if first < 128:
        return at, at + first
    n = first & 127
    if not 1 <= n <= 4 or at + n > len(data):
        return None
    size = int.from_bytes(data[at : at + n], "big")
    return (at + n, at + n + size) if size >= 128 else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the DER elements that fill this range, or none if their lengths don't add up."""
    out = []
    while at < end:
        inner = der_length(data, at + 1)
        if inner is None or inner[1] > end or data[at] & 0x1F == 0x1F:
            return None
        out.append((data[at], *inner))
        at = inner[1]
    return out


def _names_algorithm(data: bytes, start: int, end: int) -> bool:
    """A SEQUENCE's content that begins with an object identifier."""
    inner = elements(data, start, end)
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] - inner[0][1] >= 3 and data[inner[0][2] - 1] < 0x80


def _integers(data: bytes, found: list[tuple[int, int, int]]) -> bool:
    """RSA public (2), RSA private (4, or 9 with both primes), DSA private (6): sizes that fit each other."""
    sizes = [e - s for _, s, e in found]
    value = lambda i: int.from_bytes(data[found[i][1] : found[i][2]], "big")
    if not all(sizes):
        return False
    if len(sizes) == 2:
        return sizes[0] >= 64 and 1 <= sizes[1] <= 9 and value(1) % 2 == 1 and value(1) >= 3
    if len(sizes) == 6:  # version, p, q, g, y, x
        return value(0) == 0 and sizes[1] >= 64 and 20 <= sizes[2] <= 65 and all(1 <= sizes[i] <= sizes[1] + 1 for i in (3, 4)) and 1 <= sizes[5] <= sizes[2] + 1
    if len(sizes) not in (4, 9):
        return False
    whole = value(0) in (0, 1) and sizes[1] >= 64 and value(2) % 2 == 1 and 3 <= value(2) < value(1) and sizes[1] // 4 <= sizes[3] <= sizes[1] + 1
    return whole and (len(sizes) == 4 or (all(1 <= x <= sizes[1] // 2 + 2 for x in sizes[4:]) and value(4) > 1 and value(5) > 1))


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data and whose elements are those of a kind of key.

    Integers as RSA and DSA keys have them; a version, an algorithm and an octet string (PKCS#8); a version of 1 and the octets
    of an elliptic curve's private key; an algorithm and a bit string (public) or an octet string (encrypted).
    """
    if len(data) < 32 or data[0] != 0x30 or (outer := der_length(data, 1)) is None or outer[1] != len(data):
        return False
    found = elements(data, *outer)
    if not found or len(found) < 2:
        return False
    tags = [t for t, _, _ in found]
    if set(tags) == {0x02}:
        return _integers(data, found)
    (_, start, end), (_, start2, end2) = found[:2]
    if tags[0] == 0x02:
        version = int.from_bytes(data[start:end], "big")
        if tags[1] == 0x30:
            return version in (0, 1) and tags[2:3] == [0x04] and found[2][2] - found[2][1] >= 16 and _names_algorithm(data, start2, end2)
        return tags[1] == 0x04 and version == 1 and 20 <= end2 - start2 <= 72
    # an unused-bits byte of 0 before a public key's bits
    return tags[0] == 0x30 and len(tags) == 2 and _names_algorithm(data, start, end) and end2 - start2 >= 16 and (tags[1] == 0x04 or (tags[1] == 0x03 and data[start2] == 0))


def _strings(data: bytes, at: int, end: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Strings with their lengths before them up to the end, or so many of them, and where they end."""
    out = []
    while at < end if most is None else len(out) < most:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > end:
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, at


def _is_wire_key(data: bytes) -> bool:
    found = _strings(data, 0, len(data))
    return bool(found) and len(found[0]) >= 2 and found[0][0] in SSH_TYPES and sum(map(len, found[0][1:])) >= 32


def is_ssh_key(data: bytes) -> bool:
    """Strings with their lengths before them, the first a key type, that fill the data; or an OpenSSH key file.

    The file holds the names of cipher and key derivation, its options, the number of keys, so many public keys, and the private part.
    """
    if not data.startswith(b"openssh-key-v1\0"):
        return _is_wire_key(data)
    names = _strings(data, 15, len(data), 3)
    if not names or not all(re.fullmatch(rb"[a-z0-9@.-]{1,64}", n) for n in names[0][:2]):
        return False
    number = int.from_bytes(data[names[1] : names[1] + 4], "big")
    keys = _strings(data, names[1] + 4, len(data))
    return bool(keys) and 1 <= number == len(keys[0]) - 1 and all(map(_is_wire_key, keys[0][:-1])) and len(keys[0][-1]) >= 32 and len(keys[0][-1]) % 8 == 0


def decoded64(text: str) -> bytes | None:
    """The bytes of base64 with either alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(token: str) -> bool:
    """The first part is a JSON object with a known algorithm, the second one decodes to JSON too."""
    head, body, signature = token.split(".")
    try:
        header, claims = json.loads(decoded64(head) or b""), json.loads(decoded64(body) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or header.get("alg") not in JWT_ALGORITHMS:
        return False
    return header["alg"] == "none" or len(decoded64(signature) or b"") >= 32


def confirmed(text: str, long64: bool) -> list[tuple[str, int, int]]:
    """Spans that structure confirms. ``long64``: the text has 40 base64 characters in a row."""
    out = []
    if "eyJ" in text:
        done = 0
        while (at := text.find("eyJ", done)) >= 0:
            m = _JWT.match(text, at)
            if m:
                if is_signed_token(m[0]):
                    out.append(("jwt", *m.span()))
                done = m.end()
            else:
                done = at + 3
                while done < len(text) and (text[done].isascii() and text[done].isalnum() or text[done] in "_-"):
                    done += 1
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            close = f"-----END {m[1]}-----"
            begin = text.find("-----BEGIN ", m.end())  # up to the next block, so that the search stays linear
            end = text.find(close, m.end(), begin if begin >= 0 else len(text))
            if end >= 0:
                lines = [x.strip() for x in text[m.end() : end].splitlines()]
                data = decoded64("".join(x for x in lines if ":" not in x))
                if data and (is_der_key(data) or is_ssh_key(data) or any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines)):
                    out.append(("pem", m.start(), end + len(close)))
    if long64:
        inside = [(s, e) for k, s, e in out if k in ("pem", "jwt")]
        both = [m for p in (_BASE64, _URL64) for m in p.finditer(text) if p is _BASE64 or "-" in m[0] or "_" in m[0]]
        for m in both:
            found = m[0]
            if any(s <= m.start() < e for s, e in inside):
                continue
            if found.startswith(("MI", "MC", "MH", "MG", "MF", "ME", "MD")) and (data := decoded64(found)) and is_der_key(data):
                out.append(("der", *m.span()))
            elif found.startswith(("AAAA", "b3BlbnNzaC1rZXktdjE")) and (data := decoded64(found)) and is_ssh_key(data):
                out.append(("ssh", *m.span()))
        for m in _LONG_HEX.finditer(text):
            if m[0][:2] == "30" and len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
                out.append(("der", *m.span()))
    return out


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each (kind, start, end), by start and then kind."""
    if not text:
        return [], []
    classes = text.encode("utf-8", "replace").translate(_CLASS)
    base = [("assign", s, e) for s, e in assignments(text)]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in classes:
        base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    more = confirmed(text, b"b" * 40 in classes.translate(_ONE_CLASS)) if len(text) >= 40 else []
    order = lambda x: (x[1], RANK[x[0]], x[2])
    base.sort(key=order)
    return base, sorted(base + more, key=order)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
DIGEST = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_confirmed:bigint,base_sha256:string,spans:string>"


def find(docs: DataFrame, *, text: str = "text", to: str = "secrets") -> DataFrame:
    """Adds the array of all spans with what they cover."""

    def work(texts: list) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in spans(t)[1]] for t in texts], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])))

    return docs.withColumn(to, arrow_column(work, SPANS)(F.col(text)))


def digests(docs: DataFrame, *, text: str = "text", to: str = "secrets") -> DataFrame:
    """Adds a struct: counts of the base kinds, the digest of the base spans, and all spans as a string."""

    def work(texts: list) -> pa.Array:
        rows = []
        for t in texts:
            base, every = spans(t)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:BASE]]
            rows.append((*counts, len(every) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])

    return docs.withColumn(to, arrow_column(work, DIGEST)(F.col(text)))
