"""Cached gold tables are per application: a new session after a stop does
not reuse frames of the dead one."""

import subprocess
import sys
import textwrap


def test_queries_survive_session_restart(tmp_path):
    code = textwrap.dedent("""
        import sys
        sys.path.insert(0, %r)
        from closurelens.session import local_session
        import __spark_entry__ as E
        s = local_session(2)
        a = E.queries()["risk_by_dong"](s, "/root/testdata/sf0.001").collect()
        s.stop()
        s2 = local_session(2)
        b = E.queries()["risk_by_dong"](s2, "/root/testdata/sf0.001").collect()
        assert a == b, (a, b)
        print("OK")
    """) % (str(__import__("pathlib").Path(__file__).resolve().parents[1]),)
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "OK" in r.stdout, r.stderr[-2000:]
