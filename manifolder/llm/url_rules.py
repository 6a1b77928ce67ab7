"""Allow and block rules for URLs in a sorted digest array that workers memory-map.

The rules' 64-bit xxHash keys are sorted in one file, with the rules' full
strings behind them.  Spark brings the file to every executor once, a worker
maps it into memory, and keys of all candidates of a batch are looked up by
one vectorised binary search; a hit counts only if the stored string is the
candidate's, so equal digests of different strings do no harm.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import struct
import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_URL = re.compile(r"(?s)\A.*?://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HEAD = struct.Struct("<QQ")


@dataclass(frozen=True)
class Rule:
    """``host/path``: holds for the host and its subdomains, for paths that start with ``/path``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        host, slash, path = self.text.partition("/")
        return slash + path


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without a ``://``."""
    m = _URL.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def write_array(rules: list[Rule], folder: str) -> str:
    """The digest array of ``rules`` as a file named after its content."""
    by_text = {r.text: r for r in rules}
    ordered = sorted(by_text.values(), key=lambda r: (xxhash.xxh64_intdigest(r.text), r.text))
    keys = np.array([xxhash.xxh64_intdigest(r.text) for r in ordered], "<u8")
    strings = [f"{r.verdict}\t{r.text}".encode() for r in ordered]
    ends = np.cumsum([len(s) for s in strings], dtype=np.uint64).astype("<u8") if strings else np.zeros(0, "<u8")
    hosts = np.array(sorted({xxhash.xxh64_intdigest(r.host) for r in ordered}), "<u8")
    lengths = np.array(sorted({len(r.path) for r in ordered}), "<u8")
    body = b"".join([_HEAD.pack(len(keys), len(hosts)), struct.pack("<Q", len(lengths)), keys.tobytes(), ends.tobytes(), hosts.tobytes(), lengths.tobytes(), *strings])
    path = os.path.join(folder, f"url-rules-{hashlib.sha256(body).hexdigest()[:16]}")
    with open(path, "wb") as f:
        f.write(body)
    return path


class DigestArray:
    """A mapped file of :func:`write_array`."""

    def __init__(self, path: str):
        self._map = np.memmap(path, np.uint8, "r")
        n, n_hosts = _HEAD.unpack(self._map[: _HEAD.size].tobytes())
        n_lengths = int(self._map[_HEAD.size : _HEAD.size + 8].view("<u8")[0])
        at = _HEAD.size + 8
        self.keys = self._map[at : at + 8 * n].view("<u8")
        self.ends = self._map[at + 8 * n : at + 16 * n].view("<u8")
        self.hosts = self._map[at + 16 * n : at + 16 * n + 8 * n_hosts].view("<u8")
        at += 16 * n + 8 * n_hosts
        self.lengths = self._map[at : at + 8 * n_lengths].view("<u8").astype(int).tolist()
        self._strings = at + 8 * n_lengths

    def entry(self, k: int) -> tuple[str, str]:
        """Verdict and string of entry ``k``."""
        a = int(self.ends[k - 1]) if k else 0
        verdict, _, text = self._map[self._strings + a : self._strings + int(self.ends[k])].tobytes().decode().partition("\t")
        return verdict, text

    def probe(self, texts: list[str]) -> list[str | None]:
        """The verdict of each string that is in the array, else None."""
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        out: list[str | None] = [None] * len(texts)
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(last > first).tolist():
            for entry in range(first[k], last[k]):  # more than one only where digests collide
                verdict, text = self.entry(entry)
                if text == texts[k]:
                    out[k] = verdict
        return out

    def has_host(self, hosts: list[str]) -> np.ndarray:
        """Whether a rule may exist for each host; collisions only cost a lookup."""
        keys = np.fromiter((xxhash.xxh64_intdigest(h) for h in hosts), np.uint64, len(hosts))
        at = np.searchsorted(self.hosts, keys)
        return self.hosts[np.minimum(at, len(self.hosts) - 1)] == keys if len(self.hosts) else np.zeros(len(hosts), bool)

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of the longest rule that fits each (host, path); of equally long ones, the longest host's."""
        suffixes, owners = [], []
        for k, (host, _) in enumerate(urls):
            while host:
                suffixes.append(host)
                owners.append(k)
                host = host.partition(".")[2]
        likely = self.has_host(suffixes)
        texts, of = [], []
        for j in np.flatnonzero(likely).tolist():
            path = urls[owners[j]][1]
            for n in self.lengths:
                if n <= len(path):
                    texts.append(suffixes[j] + path[:n])
                    of.append((owners[j], len(suffixes[j])))
        best: dict[int, tuple] = {}
        for text, (k, host), verdict in zip(texts, of, self.probe(texts)):
            if verdict is not None and text.partition("/")[0] == text[:host] and (len(text), host) > best.get(k, ((0, 0),))[0]:
                best[k] = ((len(text), host), text, verdict)
        return [best[k][1:] if k in best else (None, None) for k in range(len(urls))]


@lru_cache(maxsize=1)
def _served_folder() -> str:
    """A folder of the driver from which Spark serves files for as long as Python lives."""
    folder = tempfile.mkdtemp(prefix="manifolder-rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@lru_cache(maxsize=4)
def _mapped(path: str) -> DigestArray:
    return DigestArray(path)


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``, without a shuffle.

    A URL that no rule fits, null ones included, gets ``default`` and a null
    rule.  Repeated rows are judged each; other columns are not read.  Of rules
    that repeat a string the last one holds.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    path = write_array(rules, _served_folder())
    name = os.path.basename(path)
    if not os.path.exists(os.path.join(SparkFiles.getRootDirectory(), name)):
        spark.sparkContext.addFile(path)

    def run(batches):
        array = _mapped(SparkFiles.get(name))
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            found = array.judge(urls)
            columns = [[h for h, _ in urls], [p for _, p in urls], [r for r, _ in found], [v or default for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
