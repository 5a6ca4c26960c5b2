"""Feature services and downloads. Every request goes through a ``fetch`` that tests replace."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, "dict | None"], bytes]


def fetch(url: str, params: dict | None = None, timeout: int = 120) -> bytes:
    full = f"{url}?{urlencode(params)}" if params else url
    with urlopen(Request(full, headers={"User-Agent": "addrloom"}), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def read_json(url: str, params: dict | None = None, get: Fetch = fetch) -> dict:
    """A JSON answer; an error object in it is raised."""
    found = json.loads(get(url, params))
    if isinstance(found, dict) and found.get("error"):
        raise RuntimeError(f"{url}: {found['error']}")
    return found


def download(url: str, path: str, get: Fetch = fetch) -> str:
    """Save a file under another name first; a file that is there stays."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path + ".part", "wb") as f:
            f.write(get(url, None))
        os.replace(path + ".part", path)
    return path


def links(page: str, pattern: str) -> list[str]:
    """Distinct matches outside comments, in order."""
    return list(dict.fromkeys(re.findall(pattern, re.sub(r"<!--.*?-->", "", page, flags=re.DOTALL), re.IGNORECASE)))


def object_id_field(layer: dict) -> str:
    typed = (f.get("name") for f in layer.get("fields") or [] if str(f.get("type", "")).lower() == "esrifieldtypeoid")
    return str(layer.get("objectIdField") or layer.get("objectIdFieldName") or next(typed, None) or "OBJECTID")


def features(query_url: str, ids: list[int], fields: str = "*", get: Fetch = fetch) -> tuple[list[dict], int]:
    """(features, ids given up) of object ids: a failed batch is halved until single ids fail."""
    pending, found, lost = [list(ids)], [], 0
    while pending:
        batch = pending.pop()
        if not batch:
            continue
        try:
            answer = read_json(query_url, {"objectIds": ",".join(map(str, batch)), "outFields": fields, "returnGeometry": "false", "f": "json"}, get)
            found += [f for f in answer.get("features") or [] if isinstance(f, dict)]
        except Exception:
            if len(batch) == 1:
                lost += 1
            else:
                half = len(batch) // 2
                pending += [batch[half:], batch[:half]]
    return found, lost


def layer_ids(url: str, where: str = "1=1", get: Fetch = fetch) -> list[int]:
    return sorted(read_json(f"{url}/query", {"where": where, "returnIdsOnly": "true", "f": "json"}, get).get("objectIds") or [])


class _Batch(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


class _LayerReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.fields, self.size, self.where = options["url"], options.get("fields", "*"), int(options.get("batch", "250")), options.get("where", "1=1")

    def partitions(self):
        ids = layer_ids(self.url, self.where)
        return [_Batch(ids[i : i + self.size]) for i in range(0, len(ids), self.size)]

    def read(self, partition):
        for feature in features(f"{self.url}/query", partition.ids, self.fields)[0]:
            yield ({k: "" if x is None else str(x) for k, x in (feature.get("attributes") or {}).items()},)


class FeatureLayer(DataSource):
    """``spark.read.format("feature_layer").option("url", ...)``: a partition per batch of ids; ``where`` and ``fields`` go to the server."""

    @classmethod
    def name(cls):
        return "feature_layer"

    def schema(self):
        return "fields map<string,string>"

    def reader(self, schema):
        return _LayerReader(self.options)


def read_layer(spark: SparkSession, url: str, **options) -> DataFrame:
    spark.dataSource.register(FeatureLayer)
    return spark.read.format("feature_layer").options(url=url, **options).load()


#: How a layer of a source configuration is dealt with.
STATUSES = ("cached", "fetched", "failed", "empty", "skipped_statewide", "skipped_protocol", "skipped_locality", "disabled")


def plan_layers(config: dict, name: str, statewide: bool = False, skip: tuple[str, ...] = ("statewide-east", "statewide-west", "statewide-partial")) -> list[tuple[dict, str]]:
    """(layer, status) of a configuration's address layers: 'fetched' are those to fetch."""
    from .conform import county_only, has_locality

    out = []
    for layer in (config.get("layers") or {}).get("addresses") or []:
        conform, coverage = layer.get("conform") or {}, config.get("coverage") or {}
        if name in skip and not statewide:
            status = "skipped_statewide"
        elif str(layer.get("protocol", "")).upper() not in ("ESRI", "HTTP"):
            status = "skipped_protocol"
        elif not has_locality(conform, coverage) and not county_only(conform, coverage):
            status = "skipped_locality"
        else:
            status = "fetched"
        out.append((layer, status))
    return out
