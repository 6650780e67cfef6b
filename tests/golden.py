"""The coffee machine of the original's first seed data set after its three services, as a nested record."""

MATERIALS = {
    "burr_steel": 160, "stl_general": 1400, "al_block": 420, "copper": 520, "brass": 140, "pctg": 700, "sil": 120, "ptfe": 35, "nbr": 60, "fr4": 180, "solder": 22, "ndfeb": 80,
}
IN_PARTS = {
    "burrs": ["burr_steel"], "motor": ["copper", "ndfeb"], "gearbox": ["stl_general"], "pump": ["brass", "stl_general", "nbr"], "flowmeter": ["brass", "ptfe"],
    "thermoblock": ["al_block", "ptfe"], "solenoid": ["brass", "ptfe"], "hoses": ["sil"], "main_pcb": ["fr4", "solder", "copper"], "ui_pcb": ["fr4", "solder"],
    "drip_tray": ["stl_general"], "waste_bin": ["stl_general"], "water_tank": ["pctg"], "milk_system": ["sil", "ptfe"], "housing": ["stl_general", "pctg"],
}


def part(key: str, *children: dict, **more) -> dict:
    # one material instance is in every part that uses it
    uses = [{"id": f"instance-{m}", "materialStaticLink": m, "weightGRM": MATERIALS[m]} for m in IN_PARTS.get(key, [])]
    return {"id": key, "name": key.replace("_", " "), "compositeMaterials": uses, "compositeParts": list(children)} | more


def z10() -> dict:
    return part(
        "machine", part("housing"), part("grinder", part("motor"), part("new_burrs"), part("gearbox")),
        part("water_system", *map(part, ("pump", "flowmeter", "thermoblock", "solenoid", "hoses"))), part("electronics", part("main_pcb"), part("ui_pcb")),
        *map(part, ("brew_group", "water_tank", "waste_bin", "drip_tray", "milk_system")),
        historyOfDetachedParts=[part("burrs")],
        partProcessTracking=[
            {"type": "ProductionStep"},
            {"type": "RepairServiceStep", "costEur": 79.0, "repairedPartId": "solenoid"},
            {"type": "ReplaceServiceStep", "costEur": 59.0, "replacedPartId": "burrs", "newPart": {"id": "new_burrs"}},
            {"type": "CleaningServiceStep", "costEur": 25.0, "cleanedPartId": "brew_group"},
        ],
    )
