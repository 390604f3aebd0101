"""HTTP endpoint on the standard library: GET /health, POST /communities/sizes (multipart: file, markers, k, resolution, seed).

Requests are served one at a time, as each is a Spark analysis of its own. A body is refused by its declared length, before it
is read, if it exceeds ``MAX_UPLOAD_BYTES`` and what the form may add.
"""

from __future__ import annotations

import json
from email.message import Message
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from eventloom.errors import EventloomError, FCSError
from eventloom.plans.pipeline import CommunityConfig, find_communities
from eventloom.provenance import VERSION
from eventloom.sources.fcs import read_fcs_bytes

MAX_UPLOAD_BYTES = 256 * 1024 * 1024
FORM_BYTES = 1024 * 1024  # of the fields beside the file
_DEFAULTS = CommunityConfig(())


class Refused(Exception):
    """A request that gets no result: HTTP status and reason."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def parse_form(content_type: str, body: bytes) -> dict[str, Message]:
    """The parts of a multipart form by name."""
    form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    if form.get_content_type() != "multipart/form-data" or not form.is_multipart():
        raise Refused(422, "the body must be multipart/form-data")
    return {str(p.get_param("name", header="content-disposition")): p for p in form.iter_parts()}


def _number(form: dict[str, Message], name: str, kind, default):
    if name not in form:
        return default
    try:
        return kind(form[name].get_payload(decode=True).decode().strip())
    except ValueError as e:
        raise Refused(422, f"{name} must be a number") from e


def community_sizes(spark: SparkSession, form: dict[str, Message]) -> dict:
    """Sizes, counts and provenance of an uploaded file's communities."""
    if "file" not in form or "markers" not in form:
        raise Refused(422, "file and markers are required")
    payload = form["file"].get_payload(decode=True)
    if not payload:
        raise Refused(400, "empty upload")
    if len(payload) > MAX_UPLOAD_BYTES:
        raise Refused(413, f"upload exceeds {MAX_UPLOAD_BYTES} bytes")
    text = form["markers"].get_payload(decode=True).decode("utf-8", "replace")
    markers = tuple(m.strip() for m in text.split(",") if m.strip())
    if not markers:
        raise Refused(422, "markers must name at least one channel")
    config = CommunityConfig(markers, k=_number(form, "k", int, _DEFAULTS.k), resolution=_number(form, "resolution", float, _DEFAULTS.resolution), seed=_number(form, "seed", int, 0))
    try:
        file = read_fcs_bytes(spark, payload, form["file"].get_filename() or "<upload>")
        result = find_communities(file, config)
        sizes = result.sizes()
    except FCSError as e:
        raise Refused(422, f"{type(e).__name__}: {e}") from e
    except EventloomError as e:
        raise Refused(400, str(e)) from e
    return {"sizes": {str(c): n for c, n in sizes.items()}, "n_events": file.layout.n_events, "n_communities": sum(c >= 0 for c in sizes), "provenance": result.provenance.to_dict()}


def make_server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/health":
                self._answer(200, {"status": "ok", "version": VERSION})
            else:
                self._answer(404, {"detail": "not found"})

        def do_POST(self) -> None:
            try:
                if self.path != "/communities/sizes":
                    raise Refused(404, "not found")
                length = self.headers.get("Content-Length", "")
                if not length.isdigit():
                    raise Refused(411, "Content-Length is required")
                if int(length) > MAX_UPLOAD_BYTES + FORM_BYTES:
                    self.close_connection = True
                    raise Refused(413, f"upload exceeds {MAX_UPLOAD_BYTES} bytes")
                form = parse_form(self.headers.get("Content-Type", ""), self.rfile.read(int(length)))
                self._answer(200, community_sizes(spark, form))
            except Refused as e:
                self._answer(e.status, {"detail": str(e)})

        def log_message(self, *_) -> None:
            pass

    return HTTPServer((host, port), Handler)
