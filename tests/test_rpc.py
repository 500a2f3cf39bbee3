import json

import pytest

from coderill.sources.rpc import RpcError, call


def test_calls_are_tried_again():
    answers, slept = iter([(429, b""), OSError("x"), (200, b'{"result": null}'), (200, b'{"result": "0x1"}')]), []

    def transport(url, body):
        assert json.loads(body)["method"] == "m"
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert call("u", "m", [], transport, sleep=slept.append, retry_null=True) == "0x1" and slept == [1, 2, 4]
    with pytest.raises(RpcError):
        call("u", "m", [], lambda u, b: (200, b'{"error": {"code": 1}}'))
    with pytest.raises(RpcError):
        call("u", "m", [], lambda u, b: (500, b""), retries=1, sleep=slept.append)
