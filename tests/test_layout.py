"""The optional subpackage stays optional."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_optional_part():
    for p in [*ROOT.glob("archivolt/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in p.relative_to(ROOT).parts and p != Path(__file__):
            assert not re.search(r"import.*\bllm\b|from archivolt\.llm", p.read_text()), p


def test_entry_works_without_it():
    code = "import sys; sys.modules['archivolt.llm'] = None; import __spark_entry__ as e; assert e.llm is None; assert 'v8_hybrid' in e.queries() and not any(k.startswith('p3') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
