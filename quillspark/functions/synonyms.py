"""Query synonyms: every word of a group stands for all of it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The groups of words that mean the same in queries.
GROUPS = """
async asynchronous
sync synchronous
auth authentication
auth authorization
config configuration configure configs
db database databases
env environment environments
repo repository repositories
app application applications
req request requests
res response responses
doc docs documentation
param parameter parameters params
arg argument arguments args
func function functions
method methods
msg message messages
obj object objects
err error errors
exc exception exceptions
srv server servers
svc service services
model models
resource resources
query queries
task tasks
event events
component components
container containers
token tokens
create creates creating created creation
build builds building built
deploy deploys deploying deployed deployment deployments
install installs installing installed installation
update updates updating updated
delete deletes deleting deleted deletion
remove removes removing removed removal
validate validates validating validated validation
test tests testing tested
exec execute executes executing executed execution
spec specs specify specifies specified specification
init initialize initializes initialized initialization
serialize serializes serializing serialized serialization serializer
cluster clusters
node nodes
endpoint endpoints
route routes routing router
api apis
url urls
schema schemas
template templates
session sessions
perm perms permission permissions
view views
handler handlers
middleware middlewares
provider providers
agent agents
policy policies
callback callbacks
pipeline pipelines
workflow workflows
cred creds credential credentials
secret secrets
var vars variable variables
attr attrs attribute attributes
instance instances
cls class classes
mod module modules
pkg package packages
dir dirs directory directories
framework frameworks
lib libs library libraries
dep deps dependency dependencies
cmd command commands
ver version versions
setting settings
opt option options
field fields
state states
ctx context contexts
conn connection connections
"""


def synonym_map(groups: str | Iterable[Iterable[str]] = GROUPS) -> dict[str, list[str]]:
    """word -> the sorted words it stands for, itself included.  A word in two groups stands for both."""
    rows = [line.split() for line in groups.split("\n") if line.strip()] if isinstance(groups, str) else groups
    found: dict[str, set[str]] = {}
    for row in rows:
        words = set(row)
        for w in words:
            found.setdefault(w, {w}).update(words)
    return {w: sorted(s) for w, s in found.items()}


def expand(term: Column, synonyms: Mapping[str, list[str]] | None = None) -> Column:
    """The words a term stands for; only itself where it has no synonym."""
    table = synonym_map() if synonyms is None else synonyms
    if not table:
        return F.array(F.lower(term))
    # A constant, read once when the plan is made: a literal map of this size would slow every plan down.
    entries = F.from_json(F.lit(json.dumps(table)), "map<string,array<string>>")
    return F.coalesce(F.try_element_at(entries, F.lower(term)), F.array(F.lower(term)))


def expand_terms(terms: Column, synonyms: Mapping[str, list[str]] | None = None) -> Column:
    """Base terms in order, then their other synonyms sorted (all with the same weight)."""
    more = F.array_sort(F.array_distinct(F.flatten(F.transform(terms, lambda t: expand(t, synonyms)))))
    return F.concat(terms, F.array_except(more, terms))


def expand_list(terms: Sequence[str], synonyms: Mapping[str, list[str]] | None = None) -> list[str]:
    """:func:`expand_terms` for terms at hand."""
    table = synonym_map() if synonyms is None else synonyms
    more = {w for t in terms for w in table.get(t.lower(), [t.lower()])}
    return [*terms, *sorted(more - set(terms))]
