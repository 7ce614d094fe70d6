"""Loading one document on the driver, with guards: size, tags, folder, and which hosts may be asked."""

from __future__ import annotations

import ipaddress
import os
import re
import socket
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urljoin, urlsplit

from leafquery.lang.lexer import QueryError

MOST_TAGS, MOST_BYTES = 100_000, 5_000_000
_START = re.compile(r"<[A-Za-z]")


@dataclass(frozen=True)
class Policy:
    """What a source may be. Nothing is fetched unless network is set, and no host of a private, loopback, link-local or
    reserved address unless private is set too; every redirect is held to the same."""

    network: bool = False
    private: bool = False
    timeout: float = 10
    most_bytes: int = MOST_BYTES
    most_redirects: int = 3
    base_dir: str | None = None


def refuse(message: str) -> QueryError:
    return QueryError("RUN-0002", message)


def checked(data: bytes | str, most_bytes: int = MOST_BYTES) -> str:
    """The text, if it is within the limits. Bytes that are not UTF-8 become replacement characters."""
    size = len(data) if isinstance(data, bytes) else len(data.encode("utf-8", "replace"))
    if size > most_bytes:
        raise QueryError("RUN-0001", f"the document is larger than {most_bytes} bytes")
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    if sum(1 for _ in _START.finditer(text)) > MOST_TAGS:
        raise QueryError("RUN-0001", f"the document has more than {MOST_TAGS} tags")
    return text


def check_host(url: str, policy: Policy, resolve: Callable[[str], list[str]] | None = None) -> None:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise refuse("only http and https addresses with a host can be loaded")
    if policy.private:
        return
    try:
        found = resolve(parts.hostname) if resolve else [i[4][0] for i in socket.getaddrinfo(parts.hostname, parts.port or 0)]
    except OSError as e:
        raise refuse(f"the host {parts.hostname} is not known") from e
    for x in found:
        at = ipaddress.ip_address(x.partition("%")[0])
        at = getattr(at, "ipv4_mapped", None) or at
        if not at.is_global or at.is_multicast:
            raise refuse("the address belongs to a private network")


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **options):
        return None  # redirects are followed by fetch(), which checks each


def fetch(url: str, policy: Policy) -> tuple[str, str]:
    """The document's text and the address that it came from in the end."""
    if not policy.network:
        raise refuse("network sources are not allowed; the caller can load them or allow the network")
    opener = urllib.request.build_opener(_Stay)
    for _ in range(policy.most_redirects + 1):
        check_host(url, policy)
        try:
            with opener.open(url, timeout=policy.timeout) as answer:
                return checked(answer.read(policy.most_bytes + 1), policy.most_bytes), url
        except urllib.error.HTTPError as e:
            target = e.headers.get("Location") if e.code in (301, 302, 303, 307, 308) else None
            if not target:
                raise refuse(f"the server answered {e.code}") from e
            url = urljoin(url, target)
        except OSError as e:
            raise refuse(f"{url} could not be fetched") from e
    raise refuse("too many redirects")


def load(source: str | bytes | Path, policy: Policy = Policy()) -> tuple[str, str]:  # noqa: B008
    """Text and name of a document given as bytes, a path, an address or markup."""
    if isinstance(source, bytes):
        return checked(source, policy.most_bytes), "document"
    if not isinstance(source, (str, Path)):
        raise TypeError("a source is bytes, a path or a string")
    text = str(source)
    if isinstance(source, str) and text.startswith(("http://", "https://")):
        return fetch(text, policy)
    if isinstance(source, Path) or len(text) < 4096 and "\0" not in text and os.path.exists(text):
        real = os.path.realpath(text)
        base = os.path.realpath(policy.base_dir) if policy.base_dir else None
        if base and os.path.commonpath([real, base]) != base:
            raise refuse("the path leaves the folder that is allowed")
        with open(real, "rb") as f:
            return checked(f.read(policy.most_bytes + 1), policy.most_bytes), text
    if "<" in text and ">" in text:
        return checked(text, policy.most_bytes), "document"
    raise refuse("the source is neither markup, nor a file, nor an address; pass bytes for raw text")
