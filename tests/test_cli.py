"""Commands from end to end, with a scripted embedding service on this host."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from passagemill import cli
from passagemill.errors import EmbeddingServiceError
from passagemill.sources import embed, readers
from passagemill.sources.snapshot import Publisher


def bag(text, dimension):
    import re

    vector = [0.0] * dimension
    for word in re.findall(r"\w+", text.lower()):
        vector[int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big") % dimension] += 1.0
    return vector


@pytest.fixture
def service():
    script, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            status = script.pop(0) if script else 200
            answer = {"data": [{"index": k, "embedding": bag(t, 1024)} for k, t in enumerate(body["input"])], "usage": {"prompt_tokens": len(body["input"])}}
            raw = json.dumps(answer if status == 200 else {"echo": body["input"]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", script, seen
    server.shutdown()


def test_client_retries_what_may_pass(service):
    url, script, seen = service
    waits = []
    client = embed.Client(url, embed.model("BAAI/bge-m3"), batch=2, sleep=waits.append)
    script += [503, 429]
    assert client.passages(["a", "b", "c"]).shape == (3, 1024)
    assert waits == [2.0, 4.0] and len(seen) == 4 and client.usage["retries"] == 2 and client.usage["prompt_tokens"] == 3
    script.append(400)
    with pytest.raises(EmbeddingServiceError, match="400") as caught:
        client.queries(["private words"])
    assert not caught.value.retryable and "private" not in str(caught.value)
    script += [500] * 4
    with pytest.raises(EmbeddingServiceError) as caught:
        client.queries(["x"])
    assert caught.value.retryable and client.passages([]).shape == (0, 1024)


def test_build_index_rank_evaluate(spark, tmp_path, service):
    url, _, _ = service
    csv = tmp_path / "cases-test.csv"
    html = "".join(f'<p id=""p-{k}"">{w} paragraph about {w} and nothing else at all.</p>' for k, w in enumerate(("contracts", "costs", "parties")))
    csv.write_text(f'id,question_texts,output,data\nd1,"[""What is said about costs here?""]","[{{""answer"": ""x"", ""citations"": [""p-1""]}}]","{html}"\n')
    root, store, runs = tmp_path / "root", tmp_path / "store", tmp_path / "runs"
    cli.main(["build", str(csv), str(root), "--sha256", readers.file_sha256(str(csv)), "--rows", "1", "--most", "10", "--target", "10", "--overlap", "0", "--least", "1"])
    snapshot = Publisher(spark, root).load()
    assert snapshot.manifest["summary"]["queries_retained"] == 1 and snapshot.manifest["summary"]["chunks"] == 3
    common = ["--model", "BAAI/bge-m3", "--revision", "r", "--endpoint", url]
    cli.main(["index", str(root), str(store), *common])
    cli.main(["rank", str(root), str(store), *common, "--output", str(runs / "one.json")])
    assert readers.run_model_id(str(runs / "one.json")) == "BAAI/bge-m3"
    qrels = tmp_path / "q.tsv"
    qrels.write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{r[0]}\t{r[1]}\t{r[2]}\n" for r in snapshot.frame("beir/qrels").collect()))
    cli.main(["evaluate", str(qrels), str(runs), "--output", str(tmp_path / "report.json"), "--k", "1", "10"])
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["models"][0]["model_id"] == "BAAI/bge-m3" and report["models"][0]["metrics"]["MRR@1"] == 1.0
