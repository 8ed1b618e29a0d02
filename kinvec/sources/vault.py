"""A vault for uploads: encrypted files whose key lives in memory only.

AES-256 in GCM mode, the nonce before the ciphertext.  The key never reaches a
query plan, a log or an executor: a vault belongs to the driver, as one person's
uploads do.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

_NAME = re.compile(r"[A-Za-z0-9._-]+")
_NONCE, _TAG_BITS = 12, 128


class Vault:
    """Files name.enc in a folder; use as a context manager, which shreds it at the end, whatever happens."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder
        self._key: bytearray | None = bytearray(os.urandom(32))
        os.makedirs(folder, exist_ok=True)

    def __enter__(self) -> Vault:
        return self

    def __exit__(self, *_) -> None:
        self.shred()

    close = lambda self: self.shred()

    def path_for(self, name: str) -> str:
        if not _NAME.fullmatch(name) or set(name) == {"."}:
            raise ValueError(f"not a name for the vault: {name!r}")
        return os.path.join(self.folder, f"{name}.enc")

    def _cipher(self, mode: int, nonce: bytes):
        if self._key is None:
            raise RuntimeError("the vault has been shredded")
        crypto = self._jvm.javax.crypto
        cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
        cipher.init(mode, crypto.spec.SecretKeySpec(bytes(self._key), "AES"), crypto.spec.GCMParameterSpec(_TAG_BITS, nonce))
        return cipher

    def store(self, name: str, plain: bytearray) -> str:
        """Encrypt and write; a bytearray that is given is zeroed afterwards."""
        path, nonce = self.path_for(name), os.urandom(_NONCE)
        body = bytes(self._cipher(1, nonce).doFinal(bytes(plain)))
        with open(path, "wb") as f:
            f.write(nonce + body)
        if isinstance(plain, bytearray):
            plain[:] = bytes(len(plain))
        return path

    def read(self, name: str) -> bytes:
        """What was stored; a file that is too short, was changed or is another vault's raises."""
        path = self.path_for(name)
        self._cipher(1, bytes(_NONCE))  # shredded?
        with open(path, "rb") as f:
            raw = f.read()
        if len(raw) <= _NONCE:
            raise ValueError(f"{name} is cut short")
        try:
            return bytes(self._cipher(2, raw[:_NONCE]).doFinal(raw[_NONCE:]))
        except Exception as e:
            raise ValueError(f"{name} can't be decrypted") from e

    def names(self) -> list[str]:
        return sorted(f[:-4] for f in os.listdir(self.folder) if f.endswith(".enc")) if os.path.isdir(self.folder) else []

    def shred(self) -> None:
        """Zero the key and delete the folder, deepest first, as far as it can be; again does nothing."""
        if self._key is not None:
            self._key[:] = bytes(len(self._key))
            self._key = None
        for root, folders, files in os.walk(self.folder, topdown=False):
            for remove, names in ((os.remove, files), (os.rmdir, folders)):
                for name in names:
                    try:
                        remove(os.path.join(root, name))
                    except OSError:
                        pass
        try:
            os.rmdir(self.folder)
        except OSError:
            pass
