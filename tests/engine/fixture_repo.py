"""A small repository in six languages, and graphs of it."""

import os
import subprocess

FILES = {
    "pkg/a.py": '''import os
from json import dumps, loads

class Base:
    """Base doc."""
    def ping(self):
        return helper(1)

class Child(Base):
    def __init__(self):
        self._x = dumps({})

def helper(n):
    def inner():
        return loads("1")
    return inner()
''',
    "main.go": '''package main
type Animal struct {
	Base
}
func (a *Animal) Speak() string {
	return helper("x")
}
func run() { helper(1) }
''',
}


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def git(root, *args):
    done = subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", "-c", "init.defaultBranch=main", *args], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def commit(root, message="c"):
    git(root, "add", "-A")
    git(root, "commit", "-qm", message, "--allow-empty")
    return git(root, "rev-parse", "HEAD")


def contents(graph):
    """Rows of every table but the times, as sets."""
    out = {}
    for name, df in graph.tables().items():
        rows = df.drop("last_indexed").collect()
        out[name] = sorted(map(repr, (tuple(r) for r in rows)))
    return out
