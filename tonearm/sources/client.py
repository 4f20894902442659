"""Requests of a service, over a transport that the caller brings: retries, error answers, signed writes."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

#: A transport takes the parameters and returns (status, body); it raises ``OSError`` when nothing came back.
Transport = Callable[[dict], tuple[int, str]]


class ServiceError(RuntimeError):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def call(transport: Transport, params: dict, attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> dict:
    """The answer to one request; lost connections, 429 and 5xx are tried again, an answer that tells an error raises."""
    for attempt in range(1, attempts + 1):
        try:
            status, body = transport(params)
        except OSError:
            if attempt == attempts:
                raise
        else:
            if status != 429 and status < 500:
                answer = json.loads(body)
                if isinstance(answer, dict) and "error" in answer:
                    raise ServiceError(int(answer["error"]), str(answer.get("message", "")))
                return answer
            if attempt == attempts:
                raise ServiceError(status, body[:200])
        pause(2.0 ** (attempt - 1))
    raise AssertionError("attempts must be positive")


def paged(transport: Transport, params: dict, head: str, pause: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """The raw pages of a paged request, as they are landed; the first page tells how many there are."""
    page, total = 1, 1
    while page <= total:
        answer = call(transport, params | {"page": page}, pause=pause)
        total = int(((answer.get(head) or {}).get("@attr") or {}).get("totalPages", 1)) if page == 1 else total
        yield json.dumps(answer)
        page += 1


def signed(method: str, api_key: str, secret: str, session: str, **fields: str) -> dict:
    """The parameters of a write: all of them, sorted by name and joined, with the secret at the end, make the signature."""
    params = fields | {"method": method, "api_key": api_key, "sk": session}
    text = "".join(k + params[k] for k in sorted(params)) + secret
    return params | {"api_sig": hashlib.md5(text.encode()).hexdigest(), "format": "json"}


def write_loves(rows: Iterable, transport: Transport, api_key: str, secret: str, session: str, loved: bool = True) -> int:
    """Sends one signed write per (artist, title) row; for ``foreachPartition`` over the loves to push."""
    n = 0
    for r in rows:
        method = "track.love" if loved else "track.unlove"
        call(transport, signed(method, api_key, secret, session, artist=r["artist"], track=r["title"]))
        n += 1
    return n


def artist_to_add(found: list[dict], mbid: str, profile: int, folder: str) -> dict:
    """What is posted to add an artist to a collection, from what a lookup of its identifier found."""
    for one in found:
        if one.get("foreignArtistId") == mbid:
            return one | {"qualityProfileId": profile, "rootFolderPath": folder, "monitored": True, "addOptions": {"searchForMissingAlbums": False}}
    raise LookupError(f"no artist {mbid!r}")
