"""Frequent function words, by language. Fixed values."""

STOP_WORDS = {
    "en": "the of and to a in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its now my made did down only way find use may",
    "fr": "de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux mais comme ont cette elle entre nous vous leur deux si même sans ses tout aussi être fait ces bien leurs où donc",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué",
}
ALL_STOP_WORDS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
