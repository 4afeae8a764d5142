"""Word lists that tokens, keywords and paths depend on, in alphabetical order.

Their contents are compatibility data: the same as in the engine whose results these functions have to match, under that
engine's license. Change one only together with the SQL and the expected results that state it.
"""

from __future__ import annotations

#: Words without information, of prose; looked at after splitting.
PROSE_STOPS = frozenset(
    (
        "a about above after again all also am an and any are as at be because been before being between both but by can could did do does each few for from "
        "get got had has have her here him his how if in into is it its just like may might more most must my need new no not now of on only or other our out "
        "over own same shall she should so some still such than that the their them then there these they this to too under up very was we what when where "
        "which while who why will with would you your"
    ).split()
)

#: The same of programs.
CODE_STOPS = frozenset(
    (
        "abstract async await begin break case catch class const continue def default delete do elif else elsif end enum except export false final finally fn "
        "for foreach from func function impl import include instanceof interface internal let loop match module mut namespace new nil none null override "
        "package private protected pub public raise require return self sizeof static struct super switch then this throw throws trait true try type typeof "
        "unless until use val var virtual void when where while with yield"
    ).split()
)

#: Whole words that are never split or dropped.
PRESERVED = frozenset(
    (
        "actix angular apache api async aws axum azure babel cargo css csv django dns docker elasticsearch esbuild express fastapi flask ftp gcp git gradle "
        "graphql grpc html http https imap ipv4 ipv6 json jwt k8s kafka kubernetes maven mongodb mysql nextjs nginx nosql npm nuxt oauth oauth2 pip postgresql "
        "qdrant rabbitmq rayon react redis rest rollup serde smtp sql sqlite ssh ssl svelte svn tcp tls tokio toml udp uri url vite vue webpack xml yaml"
    ).split()
)

#: Words that keywords leave out.
KEYWORD_STOPS = frozenset(
    (
        "a an and are as at be but by can could did do does doing done for from get got had has have he how in is it its made make may might must of on shall "
        "should that the they this to use used was what when where which who why will with would"
    ).split()
)

#: Parts of paths that say little.
DULL_PATHS = frozenset(
    (
        "app apps chunk chunks cjs cts dist feature features file files immutable index js jsx lib main manager map mjs module node nodes preload renderer "
        "repository service shared src ts tsx utils worker workers"
    ).split()
)
