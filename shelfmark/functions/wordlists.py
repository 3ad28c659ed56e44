"""Stopword lists."""

from __future__ import annotations

# The English list of the cleaning job.
ENGLISH_STOPWORDS = """
a about above after again against ain all am an and any are aren aren't as at be because been before
being below between both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don
don't down during each few for from further had hadn hadn't has hasn hasn't have haven haven't having
he he'd he'll her here hers herself he's him himself his how i i'd if i'll i'm in into is isn isn't it
it'd it'll it's its itself i've just ll m ma me mightn mightn't more most mustn mustn't my myself
needn needn't no nor not now o of off on once only or other our ours ourselves out over own re s same
shan shan't she she'd she'll she's should shouldn shouldn't should've so some such t than that that'll
the their theirs them themselves then there these they they'd they'll they're they've this those
through to too under until up ve very was wasn wasn't we we'd we'll we're were weren weren't we've
what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll your
you're yours yourself yourselves you've
""".split()

# The English list that the analyses take by default, the one of Spark ML.
ANALYSIS_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
