from conftest import rows
from texts import NODE_REPO, PYTHON_REPO

from fleetfacts.operators import dependencies as D
from fleetfacts.operators import imports as I
from fleetfacts.operators import inventory as V
from fleetfacts.operators import technologies as T


def test_technologies(make_files):
    found = rows(T.detect_technologies(make_files(*PYTHON_REPO, *NODE_REPO)))
    assert found == [
        ("shop", "FastAPI", "0.111.0", "pyproject.toml", 1.0),
        ("shop", "Python", None, "pyproject.toml", 1.0),
        ("web", "Express", "4.19.2", "package.json", 1.0),
        ("web", "JavaScript", None, "package.json", 0.8),
        ("web", "Node.js", None, "package.json", 0.9),
        ("web", "TypeScript", "5.4.5", "package.json", 1.0),
    ]


def test_other_manifests(make_files):
    files = make_files(
        ("a", "go.mod", "module x\n\ngo 1.22\n"),
        ("b", "go.mod", "module x\n"),
        ("c", "Cargo.toml", "not [ toml"),
        ("d", "Dockerfile", "# base\nfrom python:3.12 AS x\nFROM  node:20\nRUN go\n"),
        ("e", ".github/workflows/z.yml", ""),
        ("e", ".github/workflows/ci.yml", ""),
        ("f", "requirements.txt", "flask-login==0.6\nDjango\nflask==2.0\n"),
        ("g", "package.json", "{broken"),
        ("g", "node_modules/a.rs", ""),
        ("g", "lib/a.rs", ""),
        ("h", "pyproject.toml", "= bad"),
        ("i", "sub/package.json", "{}"),
        ("j", "package.json", '{"dependencies": {"@types/react": "1", "next": "latest"}}'),
    )
    assert rows(T.detect_technologies(files)) == [
        ("a", "Go", "1.22", "go.mod", 1.0),
        ("b", "Go", None, "go.mod", 1.0),
        ("c", "Rust", None, "Cargo.toml", 1.0),
        ("d", "Docker", None, "Dockerfile", 1.0),
        ("d", "Node.js", None, "Dockerfile", 0.9),
        ("d", "Python", None, "Dockerfile", 0.9),
        ("e", "GitHub Actions", None, ".github/workflows/ci.yml", 1.0),
        ("f", "Django", None, "requirements.txt", 1.0),
        ("f", "Flask", "0.6", "requirements.txt", 1.0),
        ("f", "Python", None, "requirements.txt", 0.9),
        ("g", "Rust", None, "file_extension", 0.7),
        ("j", "JavaScript", None, "package.json", 0.8),
        ("j", "Next.js", None, "package.json", 1.0),
        ("j", "Node.js", None, "package.json", 0.9),
        ("j", "React", None, "package.json", 1.0),
    ]


def test_dependencies(make_files):
    files = make_files(
        *PYTHON_REPO,
        *NODE_REPO,
        (
            "g",
            "go.mod",
            "module x\nrequire a/one v1.0\n require (\n\tb/two v2 // indirect\n  // note here\n\n c/three v3\n)\n"
            "require d/four v4\nreplace x => y\nrequire (\n e/five v5\n)\n",
        ),
        (
            "c",
            "Cargo.toml",
            '[dependencies]\nserde = "1.0"\ntokio = {version = "1", features = ["full"]}\nlocal = {path = "x"}\n'
            '[dev-dependencies]\nz = "9"\n',
        ),
        ("p", "requirements.txt", "My_Pkg[extra] >= 1.0 ; x\n-r other.txt\n  zed\n"),
    )
    deps = D.extract_dependencies(files)
    assert rows(deps, "repo_id", "ecosystem", "name", "version", "source") == [
        ("c", "cargo", "local", None, "Cargo.toml"),
        ("c", "cargo", "serde", "1.0", "Cargo.toml"),
        ("c", "cargo", "tokio", "1", "Cargo.toml"),
        ("g", "go", "a/one", "v1.0", "go.mod"),
        ("g", "go", "b/two", "v2", "go.mod"),
        ("g", "go", "c/three", "v3", "go.mod"),
        ("g", "go", "d/four", "v4", "go.mod"),
        ("g", "go", "e/five", "v5", "go.mod"),
        ("p", "pypi", "-r other.txt", None, "requirements.txt"),
        ("p", "pypi", "my-pkg", ">= 1.0 ; x", "requirements.txt"),
        ("p", "pypi", "zed", None, "requirements.txt"),
        ("shop", "pypi", "fastapi", ">=0.111.0", "pyproject.toml"),
        ("shop", "pypi", "fastapi", ">=0.111.0", "requirements.txt"),
        ("shop", "pypi", "httpx", ">=0.27.0", "pyproject.toml"),
        ("shop", "pypi", "httpx", ">=0.27.0", "requirements.txt"),
        ("shop", "pypi", "pydantic", ">=2.7.0", "pyproject.toml"),
        ("shop", "pypi", "pydantic", ">=2.7.0", "requirements.txt"),
        ("shop", "pypi", "pytest", ">=8.2.0", "requirements.txt"),
        ("web", "npm", "empty", None, "package.json"),
        ("web", "npm", "express", "*", "package.json"),
        ("web", "npm", "express", "^4.19.2", "package.json"),
        ("web", "npm", "jsonwebtoken", "^9.0.2", "package.json"),
        ("web", "npm", "typescript", "^5.4.5", "package.json"),
    ]
    grouped = D.dependencies_by_ecosystem(deps)
    assert rows(grouped, "repo_id", "ecosystem", "dependency_count")[-1] == ("web", "npm", 5)
    drift = D.fleet_dependency_versions(deps).where("name = 'express'").first()
    assert (drift.repo_count, drift.version_count) == (1, 2)


def test_import_edges(make_files):
    edges = I.import_edges(make_files(*PYTHON_REPO, *NODE_REPO))
    assert rows(edges, "repo_id", "from_component", "to_component") == [
        ("shop", "src/main.py", "src/orders/cart.py"),
        ("shop", "src/main.py", "src/orders/mail.py"),
        ("shop", "src/orders/cart.py", "src/orders/mail.py"),
        ("web", "src/api/users.ts", "src/store/index.ts"),
        ("web", "src/index.ts", "src/api/users.ts"),
        ("web", "src/util.js", "src/index.ts"),
    ]
    assert rows(I.graph_nodes(edges), "repo_id", "name")[0] == ("shop", "cart.py")


def test_import_preference(make_files):
    files = make_files(
        ("r", "a.py", ""),
        ("r", "a/__init__.py", ""),
        ("r", "src/a.py", ""),
        ("r", "b/__init__.py", ""),
        ("r", "src/b.py", ""),
        ("r", "src/c.py", ""),
        ("r", "src/c/__init__.py", ""),
        ("r", "src/d/__init__.py", ""),
        ("r", "venv/e.py", ""),
        ("r", "m.py", "import a\nimport b\nimport c\nimport d\nimport e\nimport m\nimport os, sys\nfrom src.c import x\n"),
        ("s", "m.py", "import a\n"),
    )
    assert rows(I.import_edges(files), "from_component", "to_component") == [
        ("m.py", "a.py"),
        ("m.py", "b/__init__.py"),
        ("m.py", "src/c.py"),
        ("m.py", "src/c.py"),
        ("m.py", "src/d/__init__.py"),
    ]


def test_inventory_and_rollup(make_files):
    files = make_files(
        ("r", ".git/config", "x"),
        ("r", "src/build", "file named like a directory"),
        ("r", "src/a/b.test.py", "12345"),
        ("r", ".env.example", ""),
        ("r", ".gitignore", ""),
        ("r", ".github/workflows/ci.yml", ""),
        ("r", "Dockerfile", ""),
    )
    inventory = V.file_inventory(files)
    assert rows(inventory, "path", "extension", "is_important") == [
        (".env.example", ".example", True),
        (".github/workflows/ci.yml", ".yml", True),
        (".gitignore", "", False),
        ("Dockerfile", "", True),
        ("src/a/b.test.py", ".py", False),
        ("src/build", "", False),
    ]
    assert rows(V.exclude_vendored(files), "path")[-1] == ("src/a/b.test.py",)
    rollup = V.directory_rollup(inventory)
    assert rows(rollup, "directory", "name", "depth", "file_count", "total_bytes") == [
        (".github", ".github", 1, 1, 0),
        (".github/workflows", "workflows", 2, 1, 0),
        ("src", "src", 1, 2, 32),
        ("src/a", "a", 2, 1, 5),
    ]


def test_decoding(spark):
    raw = spark.createDataFrame(
        [("r", "a", b"ok\r\nx"), ("r", "b", b"bad\xffbyte"), ("r", "c", "é�".encode())],
        "repo_id string, path string, content binary",
    )
    assert rows(V.decode_content(raw), "path", "content") == [
        ("a", "ok\nx"), ("b", "badbyte"), ("c", "é�"),
    ]
    assert rows(V.decode_content(raw, "strict"), "path") == [("a",), ("c",)]
    assert rows(V.undecodable_files(raw), "path") == [("b",)]


def test_snapshot_changes(make_files, spark):
    old = make_files(("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1"))
    new = make_files(("r", "a", "1"), ("r", "b", "2"), ("s", "c", "1"))
    assert rows(V.snapshot_changes(old, new)) == [
        ("r", "b", "modified"), ("r", "c", "deleted"), ("s", "c", "added"),
    ]
    chosen = spark.createDataFrame([("r", "b")], "repo_id string, path string")
    assert rows(V.snapshot_changes(old, new, chosen)) == [("r", "b", "modified")]
