"""Options of the jobs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default exclusions and languages.
EXCLUDES = (".git/", ".spellaudit_wordlists/", ".DS_Store", "Gemfile.lock", ".rspec_status", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", ".gitkeep", ".keep", "*.svg", "*.eot", "*.ttf", "*.woff", "*.woff2", "*.zip", "*.pdf", "*.xlsx", "*.gz")


@dataclass(frozen=True)
class Language:
    name: str
    includes: tuple[str, ...] = ()
    hashbangs: tuple[str, ...] = ()


LANGUAGES = (
    Language("ruby", ("*.rb", "*.rake", "*.gemspec", "*.erb", "*.haml", "*.jbuilder", "*.builder", "Gemfile", "Rakefile", "config.ru", "Capfile", ".simplecov"), ("ruby",)),
    Language("html", ("*.html", "*.hml", "*.jsx", "*.tsx", "*.js", "*.ts", "*.jsx.snap", "*.tsx.snap", "*.coffee", "*.haml", "*.erb", "*.rb", "*.builder", "*.css", "*.scss", "*.sass", "*.less")),
    Language("javascript", ("*.html", "*.hml", "*.jsx", "*.tsx", "*.js", "*.ts", "*.jsx.snap", "*.tsx.snap", "*.coffee", "*.haml", "*.erb", "*.json")),
    Language("shell", ("*.sh", "Dockerfile"), ("bash", "sh")),
    Language("dockerfile", ("Dockerfile",)),
    Language("css", ("*.css", "*.sass", "*.scss", "*.less")),
    Language("xml", ("*.xml", "*.html", "*.haml", "*.hml", "*.svg")),
)


@dataclass(frozen=True)
class Options:
    """marker: the word that starts directives; terms: the list of the tool's own words; key_weight: powers of ten for key classes."""

    min_length: int = 3
    key_weight: int = 5
    marker: str = "spellaudit"
    terms: str = "tool_terms"
    locales: tuple[str, ...] = ("US",)
    excludes: tuple[str, ...] = EXCLUDES
    languages: tuple[Language, ...] = LANGUAGES
    skip_data_uris: bool = False
    more_excludes: tuple[str, ...] = field(default=())
