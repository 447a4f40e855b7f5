"""Which files of a tree are indexed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.paths import any_glob, base_name, extension, validated

# Extensions of source, documentation, infrastructure and text configuration.
INCLUDE_EXTENSIONS = (
    ".md .markdown .mdx .html .htm .css .scss .sass .less "
    ".go .py .pyi .pyx .pxd .pxi .js .jsx .mjs .cjs .ts .tsx .mts .cts .vue .svelte .rs "
    ".c .h .cc .cpp .cxx .hh .hpp .hxx .m .mm .cu .cuh .cl .java .kt .kts .scala .sc .groovy .swift .cs .fs .fsx .fsi .vb "
    ".ml .mli .re .rei .hs .lhs .erl .hrl .ex .exs .clj .cljs .cljc .edn .rb .rake .php .lua .r .jl .dart .zig .nim "
    ".v .sv .svh .vhd .vhdl .asm .s .wat .sh .bash .zsh .fish .ps1 .bat .cmd .sql .proto .thrift .graphql .gql .sol "
    ".tf .tfvars .hcl .cue .nix .yaml .yml .toml .json .jsonc .xml .ini .cfg .conf .properties .gradle .bzl .bazel .cmake .mk .opam .plist"
).split()

# Names of source and build files without a telling extension.
INCLUDE_PATTERNS = (
    "Dockerfile Dockerfile.* Containerfile Containerfile.* Makefile makefile GNUmakefile CMakeLists.txt meson.build meson_options.txt "
    "BUILD BUILD.* WORKSPACE WORKSPACE.* MODULE.bazel Justfile Taskfile.yml Taskfile.yaml Tiltfile Procfile go.mod go.sum go.work go.work.sum "
    "Cargo.toml Cargo.lock rust-toolchain rust-toolchain.toml dune dune-project dune-workspace pyproject.toml requirements*.txt constraints*.txt "
    "Pipfile Pipfile.lock poetry.lock uv.lock setup.py setup.cfg tox.ini package.json package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock "
    "bun.lock deno.json deno.jsonc tsconfig*.json jsconfig*.json Gemfile Gemfile.lock Rakefile Podfile Podfile.lock .gitignore .gitattributes "
    ".gitmodules .editorconfig .dockerignore .npmrc .nvmrc .python-version .tool-versions .env.example .env.sample configure gradlew mvnw waf"
).split()

# Names of folders that hold nothing written by hand.
EXCLUDE_PATTERNS = (
    ".git .hg .svn .repo .jj .cache .ccache .sccache .bazel-cache bazel-* buck-out node_modules bower_components jspm_packages .npm .npm-cache "
    ".pnpm-store .parcel-cache .webpack-cache .vite .next .nuxt .svelte-kit .angular .docusaurus .turbo .nx .nyc_output storybook-static __pycache__ "
    ".mypy_cache .pytest_cache .ruff_cache .pytype .pyre .tox .nox .hypothesis .venv venv .uv-cache .eggs *.egg-info pip-wheel-metadata "
    ".ipynb_checkpoints _build _opam .opam-switch target .gradle .pants.d build dist out coverage htmlcov DerivedData Pods"
).split()

# Language of a file by its extension.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".java": "java", ".kt": "kotlin",
    ".swift": "swift", ".md": "markdown", ".sql": "sql", ".sh": "shell",
}


@dataclass(frozen=True)
class Policy:
    """Allow list of names and deny list of path components. Additional patterns come on top of the defaults."""

    include_extensions: Sequence[str] = tuple(INCLUDE_EXTENSIONS)
    include_patterns: Sequence[str] = tuple(INCLUDE_PATTERNS)
    exclude_patterns: Sequence[str] = tuple(EXCLUDE_PATTERNS)
    extra_include: Sequence[str] = field(default=())
    extra_exclude: Sequence[str] = field(default=())
    all_files: bool = False

    def __post_init__(self) -> None:
        validated(list(self.extra_include))
        validated(list(self.extra_exclude))

    @property
    def included_names(self) -> str:
        return any_glob([*self.include_patterns, *validated(list(self.extra_include))])

    @property
    def excluded_components(self) -> str:
        return any_glob([*self.exclude_patterns, *validated(list(self.extra_exclude))])

    def includes(self, name: Column, kind: Column) -> Column:
        """Folders and links always; files by extension or name."""
        if self.all_files:
            return F.lit(True)
        return (kind != "file") | extension(name).isin(*self.include_extensions) | base_name(name).rlike(self.included_names)

    def excludes(self, path: Column, root: Column | str) -> Column:
        """Whether a component below the root is denied; the root itself never is."""
        root = F.lit(root) if isinstance(root, str) else root
        below = F.substring(path, F.char_length(root) + 2, F.char_length(path))
        return F.exists(F.split(below, "/"), lambda c: c.rlike(self.excluded_components))


def language(path: Column) -> Column:
    """Language by extension, or an empty text."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(""))


def is_index_artifact(path: Column, database: str) -> Column:
    """The index's own files, which are never indexed."""
    return path.isin(database, *(f"{database}-{x}" for x in ("wal", "shm", "journal")))
