"""Ed25519 signatures of scan results.

The ``cryptography`` package signs if it is installed; otherwise the session's JVM does, with keys in
the same containers (PKCS 8 and SubjectPublicKeyInfo, as PEM).
"""

from __future__ import annotations

import base64
import json
import textwrap
from dataclasses import dataclass

try:
    from cryptography.exceptions import InvalidSignature
    from cryptography.hazmat.primitives.asymmetric import ed25519
    from cryptography.hazmat.primitives.serialization import Encoding, NoEncryption, PrivateFormat, PublicFormat, load_pem_private_key, load_pem_public_key
except ImportError:
    ed25519 = None


@dataclass(frozen=True)
class KeyPair:
    private_key_pem: str
    public_key_pem: str


def canonical_json_bytes(data: dict) -> bytes:
    """Sorted keys, no spaces, UTF-8 without escapes."""
    return json.dumps(data, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()


def _pem(kind: str, der: bytes) -> str:
    body = "\n".join(textwrap.wrap(base64.b64encode(der).decode(), 64))
    return f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----\n"


def _der(pem: str, kind: str) -> bytes:
    head, end = f"-----BEGIN {kind}-----", f"-----END {kind}-----"
    if head not in pem or end not in pem:
        raise ValueError(f"this is no PEM of a {kind.lower()}")
    return base64.b64decode("".join(pem.split(head)[1].split(end)[0].split()))


def _jvm():
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("signing needs the cryptography package or a Spark session")
    return session.sparkContext._gateway, session.sparkContext._jvm.java.security


def _jvm_key(pem: str, private: bool):
    gateway, security = _jvm()
    der = bytearray(_der(pem, "PRIVATE KEY" if private else "PUBLIC KEY"))
    factory = security.KeyFactory.getInstance("Ed25519")
    try:
        if private:
            return factory.generatePrivate(security.spec.PKCS8EncodedKeySpec(der))
        return factory.generatePublic(security.spec.X509EncodedKeySpec(der))
    except Exception as error:
        raise ValueError("this is no Ed25519 key") from error


def generate_ed25519_keypair() -> KeyPair:
    if ed25519 is not None:
        key = ed25519.Ed25519PrivateKey.generate()
        private = key.private_bytes(Encoding.PEM, PrivateFormat.PKCS8, NoEncryption())
        public = key.public_key().public_bytes(Encoding.PEM, PublicFormat.SubjectPublicKeyInfo)
        return KeyPair(private.decode(), public.decode())
    gateway, security = _jvm()
    pair = security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory, named = security.KeyFactory.getInstance("Ed25519"), gateway.jvm.java.lang.Class.forName
    # a key's own getEncoded() belongs to a class that the gateway can't reach
    private = factory.getKeySpec(pair.getPrivate(), named("java.security.spec.PKCS8EncodedKeySpec")).getEncoded()
    public = factory.getKeySpec(pair.getPublic(), named("java.security.spec.X509EncodedKeySpec")).getEncoded()
    return KeyPair(_pem("PRIVATE KEY", bytes(private)), _pem("PUBLIC KEY", bytes(public)))


def sign_payload(*, private_key_pem: str, payload: bytes) -> str:
    """The signature in base 64; a key of another kind is a ValueError."""
    if ed25519 is not None:
        key = load_pem_private_key(private_key_pem.encode(), password=None)
        if not isinstance(key, ed25519.Ed25519PrivateKey):
            raise ValueError("this is no Ed25519 key")
        return base64.b64encode(key.sign(payload)).decode()
    signer = _jvm()[1].Signature.getInstance("Ed25519")
    signer.initSign(_jvm_key(private_key_pem, True))
    signer.update(bytearray(payload))
    return base64.b64encode(bytes(signer.sign())).decode()


def verify_payload(*, public_key_pem: str, signature_b64: str, payload: bytes) -> bool:
    """Whether the signature fits; one that can't be read doesn't, a key of another kind is a ValueError."""
    if ed25519 is not None:
        key = load_pem_public_key(public_key_pem.encode())
        if not isinstance(key, ed25519.Ed25519PublicKey):
            raise ValueError("this is no Ed25519 key")
        try:
            key.verify(base64.b64decode(signature_b64), payload)
            return True
        except (InvalidSignature, ValueError):
            return False
    key = _jvm_key(public_key_pem, False)
    try:
        checker = _jvm()[1].Signature.getInstance("Ed25519")
        checker.initVerify(key)
        checker.update(bytearray(payload))
        return bool(checker.verify(bytearray(base64.b64decode(signature_b64))))
    except Exception:
        return False
