"""A small code tree for tests of parsers."""

from __future__ import annotations

FILES = {
    "app/main.py": "from app.util import load, clean\n\n\ndef run(path):\n    rows = load(path)\n    return [step(r) for r in rows]\n\n\ndef step(row):\n    return clean(row)\n\n\nclass Job:\n    \"\"\"A job.\"\"\"\n\n    def start(self) -> int:\n        run('x')\n        self.stop()\n        return missing()\n\n    def stop(self):\n        pass\n",
    "app/util.py": "def load(path: str) -> list:\n    return open(path).read().split()\n\n\ndef clean(x):\n    return x.strip()\n\n\ndef twice():\n    return clean(1)\n",
    "lib/text.py": "def twice():\n    return 2\n\n\ndef caller():\n    return twice()\n\n\ndef outer():\n    return clean('a')\n",
    "lib/bad.py": "def broken(:\n",
    "src/core.c": "#define LIMIT 8\n\nstatic int add(int a, int b)\n{\n    return a + b;\n}\n\nint main(void) {\n    return add(1, LIMIT);\n}\n",
    "web/view.js": "export function renderPage(x) {\n  return drawHtml(x);\n}\n\nclass PageView {\n}\n",
}


def files(spark):
    return spark.createDataFrame(sorted(FILES.items()), "path string, content string")
