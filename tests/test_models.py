import hashlib

import pytest

from tessella.sources import models


def test_cached_and_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = tmp_path / "in" / "m.onnx"
    source.write_bytes(b"weights" * 1000)
    sha = hashlib.sha256(source.read_bytes()).hexdigest()
    url, folder = source.as_uri(), str(tmp_path / "cache")
    path = models.cached(url, folder, sha)
    assert models.file_sha256(path) == sha and models.cached(str(source), folder, sha.upper()) == str(source)
    (tmp_path / "cache" / "m.onnx").write_bytes(b"broken")
    assert models.file_sha256(models.cached(url, folder, sha)) == sha
    with pytest.raises(ValueError, match="SHA-256"):
        models.cached(url, str(tmp_path / "other"), "0" * 64)
    assert not list((tmp_path / "other").glob("*"))
    with pytest.raises(FileNotFoundError):
        models.cached(str(tmp_path / "none"), folder)
    assert [(r.length, r.sha256) for r in models.digests(spark, str(tmp_path / "in")).collect()] == [(7000, sha)]
