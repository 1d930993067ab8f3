"""Files of learned models: fetched once into a folder, and used only with the content that is expected."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import urllib.request
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sha256(path: str) -> str:
    """SHA-256 of a file in lowercase hex, read in parts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cached(source: str, folder: str, sha256: str | None = None) -> str:
    """Path of the model: source itself if it is a path, else (a URL) its copy in folder, which is fetched if it isn't there or if its
    content isn't the expected one. A file whose SHA-256 isn't the stated one is an error; a wrong copy is removed."""
    remote = re.match(r"\w+://", source) is not None
    path = os.path.join(folder, os.path.basename(source.split("?")[0])) if remote else source
    if remote and (not os.path.exists(path) or sha256 and file_sha256(path) != sha256.lower()):
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        try:
            with urllib.request.urlopen(source) as r, open(part, "wb") as f:
                shutil.copyfileobj(r, f)
            if sha256 and file_sha256(part) != sha256.lower():
                raise ValueError(f"{source} does not have the expected SHA-256")
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if sha256 and file_sha256(path) != sha256.lower():
        raise ValueError(f"{path} does not have the expected SHA-256")
    return path


def digests(spark: SparkSession, root: str) -> DataFrame:
    """path, length, sha256 of all files under root; contents don't leave the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))
