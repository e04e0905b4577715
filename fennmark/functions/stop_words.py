"""Words that do not count as terms: fixed values, in the order of their source."""

# Fixed values. Common words.
STOP_WORDS = (
    "att och det som för med till ska skall inte den de man har kan bör från om en ett är av på eller samt vår våra alla mer fler detta denna sig sina vara "
    "blir genom under över efter innan sedan även också andra annat sådan sådana samma varje vilket vilka vilken dessa deras sitt hans hennes något några "
    "ingen inget inga mycket många flera därför eftersom medan utan mellan både finns gäller göra gör ligger kommer skulle kunna måste behöver vill vilja "
    "bland hela helt olika stor stort stora större mindre enligt inom inklusive samtidigt dessutom exempelvis respektive omkring cirka samtliga delvis "
    "endast redan ännu alltid aldrig"
).split()

# Fixed values. Words of parliamentary formulas.
FORMULA_WORDS = (
    "riksdagen riksdag riksdagens motion motionen motionens motionär motionärer motionärerna yrkande yrkanden yrkar tillkännager tillkännagivande "
    "tillkännagivandet anförs anför bakom ställer regeringen regering regeringens utskottet utskottets utskott proposition propositionen propositionens "
    "betänkande betänkandet beslut beslutar beslutat förslag förslaget föreslår föreslås avslår avslag bifaller bifall punkt punkten kapitel stycket lagen "
    "lag ändring ändringar därmed vidare således följande avseende gällande fråga frågan frågor svar svarar statsrådet minister ministern interpellation "
    "interpellationen votering voteringen kammaren ledamot ledamöter sverige svensk svenska svenskt landet arbete arbetet insatser åtgärder åtgärd behov "
    "möjlighet möjligheter syfte syftet"
).split()

# Fixed values. Words that say nothing of a text's subject.
EMPTY_WORDS = (
    "anledning anledningen anledningar anledningarna bakgrund bakgrunden motivering motiveringen avser avses avse anser anses anse avstyrker avstyrkt "
    "avstyrkte avstyrktes tillstyrker avvisar avvisa avvisas avvisade avvisades avvisat sammantaget anslagsförslag anslagsfördelning riksdagsbeslut "
    "anförande anföranden anförandet viktig viktigt viktiga viktigare viktigaste bättre bäst bästa borde bör krävs kräver betydande betydelse betydelsen "
    "betydligt betyder avgörande avgöra avgörs avgöras allvarlig allvarligt allvarliga allvarligare allvarligaste behövs behöva behövas behovet behoven "
    "förutsättningar förutsättningarna förutsättning förutsättningen använda används användas använder använts innebär innebära bidra bidrar skapa skapar "
    "skapas agera agerar agerat agerande överväga överväger arbeta arbetar arbetat arbetade arbetas allt alltmer annan annans båda bara dock fram idag "
    "dagens dags dagar dagen dagligen fall antalet antal delar dels dela delas delat sätt sätta sätter exempel härav därtill således"
).split()

# Fixed values. Names of parties and of their members.
PARTY_NAMES = (
    "socialdemokraterna socialdemokratiska socialdemokrat socialdemokrater moderaterna moderata moderat moderater sverigedemokraterna sverigedemokratiska "
    "sverigedemokrat sverigedemokrater centerpartiet centerpartiets centerpartist centerpartister vänsterpartiet vänsterpartiets vänsterpartist "
    "vänsterpartister kristdemokraterna kristdemokratiska kristdemokrat kristdemokrater liberalerna liberala liberal miljöpartiet miljöpartiets "
    "miljöpartist miljöpartister"
).split()
