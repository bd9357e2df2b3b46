"""Polling a cluster's API for its documents, with a held pod list."""

from __future__ import annotations

import json
import os
import ssl
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# fixed values: where a pod finds its cluster
ACCOUNT_DIR = "/var/run/secrets/kubernetes.io/serviceaccount"
NODES_PATH, PODS_PATH, SUMMARY_PATH = "/api/v1/nodes", "/api/v1/pods", "/api/v1/nodes/{node}/proxy/stats/summary"
TIMEOUT = 20


@dataclass(frozen=True)
class Config:
    """Settings from the environment; what is absent or no number takes its default, what is
    too small its least value."""

    scrape_seconds: int = 30
    retention_seconds: int = 24 * 3600
    listen: str = "0.0.0.0:9090"
    snapshot_path: str | None = None
    snapshot_seconds: int = 300
    pod_refresh_seconds: int = 300

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        def number(name: str, default: int) -> int:
            try:
                return max(1, int(env[name]))
            except (KeyError, ValueError):
                return default

        return cls(
            number("SCRAPE_INTERVAL_SECONDS", 30),
            number("RETENTION_HOURS", 24) * 3600,
            env.get("LISTEN_ADDR", "0.0.0.0:9090"),
            env.get("SNAPSHOT_PATH", "").strip() and env["SNAPSHOT_PATH"] or None,
            number("SNAPSHOT_INTERVAL_SECONDS", 300),
            number("POD_REFRESH_INTERVAL_SECONDS", 300),
        )


class Client:
    """GETs documents as text. The token is read again for each request: it changes in place."""

    def __init__(self, base: str, token_path: str, ca_path: str | None = None):
        self.base, self.token_path = base, token_path
        self.context = ssl.create_default_context(cafile=ca_path) if ca_path else None

    @classmethod
    def in_cluster(cls, env=os.environ) -> Client:
        if "KUBERNETES_SERVICE_HOST" not in env:
            raise RuntimeError("KUBERNETES_SERVICE_HOST is unset: not inside a cluster")
        host, port = env["KUBERNETES_SERVICE_HOST"], env.get("KUBERNETES_SERVICE_PORT", "443")
        return cls(f"https://{f'[{host}]' if ':' in host else host}:{port}", f"{ACCOUNT_DIR}/token", f"{ACCOUNT_DIR}/ca.crt")

    def get(self, path: str) -> str:
        with open(self.token_path) as f:
            token = f.read().strip()
        request = urllib.request.Request(self.base + path, headers={"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT, context=self.context) as reply:
                return reply.read().decode()
        except urllib.error.HTTPError as e:
            raise OSError(f"GET {path} returned {e.code}: {e.read().decode('utf-8', 'replace').strip()}") from e


class BadDocument(ValueError):
    """An answer that is not the document asked for."""


def listed(text: str, path: str) -> list[dict]:
    """The items of a list document, each of which must have metadata."""
    try:
        items = json.loads(text).get("items", [])
        if not all(isinstance(x["metadata"], dict) for x in items):
            raise TypeError("metadata is no object")
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise BadDocument(f"decoding {path}: {e!r}") from e
    return items


@dataclass
class Pods:
    """The pod list held between passes."""

    every: int
    text: str | None = None
    at: int = 0
    stale: bool = False
    failures: list[str] = field(default_factory=list)

    def due(self, now: int) -> bool:
        return self.text is None or self.stale or now - self.at >= self.every

    def current(self, client, now: int) -> str:
        """The list, fetched anew if it is due. A fetch that fails, or gives no list, keeps the
        list held; with none held it fails the pass."""
        if self.due(now):
            try:
                text = client.get(PODS_PATH)
                listed(text, PODS_PATH)
                self.text, self.at, self.stale = text, now, False
            except (OSError, BadDocument) as e:
                if self.text is None:
                    raise
                self.failures.append(str(e))
        return self.text


def documents(spark: SparkSession, client, pods: Pods, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, pods, summaries) of one pass, for collected(). Without the node list, or with
    an answer that is none, the pass fails; a node that does not answer has a null summary and costs the others nothing.
    A node's name is all that the driver reads of the documents."""
    nodes = client.get(NODES_PATH)
    names = [str(x["metadata"].get("name", "")) for x in listed(nodes, NODES_PATH)]
    held = pods.current(client, now)
    answers = []
    for name in names:
        try:
            answers.append((name, client.get(SUMMARY_PATH.format(node=name))))
        except OSError:
            answers.append((name, None))
    return (
        spark.createDataFrame([(nodes,)], "doc string"),
        spark.createDataFrame([(held,)], "doc string"),
        spark.createDataFrame(answers, "node string, doc string"),
    )
