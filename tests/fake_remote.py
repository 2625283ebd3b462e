"""A remote side for the paged source: 30 nodes, newest first; calls time out over 10 nodes a page."""

import datetime as dt

from sagefold.sources import paged

NODES = [{"number": 100 - k, "updatedAt": (dt.datetime(2026, 1, 1) - dt.timedelta(hours=k)).isoformat(), "comments": {"nodes": [{"id": 0}], "pageInfo": {"hasNextPage": True, "endCursor": "0"}}} for k in range(30)]


def transport(v: dict) -> dict:
    if v["connection"] != "pullRequests":
        k = int(v["after"]) + 1
        return {"nodes": [{"id": k}], "pageInfo": {"hasNextPage": k < 2, "endCursor": str(k)}}
    if v["first"] > 10:
        raise paged.Timeout
    at = int(v["after"] or 0)
    end = at + v["first"]
    return {"nodes": [{**n, "comments": {**n["comments"]}} for n in NODES[at:end]], "pageInfo": {"hasNextPage": end < len(NODES), "endCursor": str(end)}}
