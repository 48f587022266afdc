"""Row-by-row replay of refine runs and edits in plain Python, to check the set-based plans."""

import hashlib
import re
import uuid
from dataclasses import dataclass, field

NUMERIC = {"numero", "superficie", "largo", "moneda", "porcentaje", "peso"}

def is_empty(value):
    return value is None or value != value or (isinstance(value, str) and not value.strip())


def clean(value, kind):
    kind = kind.strip().lower()
    if is_empty(value):
        if kind == "internal_id":
            raise ValueError("empty internal id")
        return None
    if kind in NUMERIC:
        kept = [c for c in str(value).replace(",", ".") if c in "0123456789.+-"]
        return "".join(kept) or None
    return re.sub(r"\s+", " ", str(value)).strip()


def hashed(value):
    return hashlib.sha256((value or "").encode()).hexdigest()


@dataclass
class Replay:
    vault: list = field(default_factory=list)
    inventory: dict = field(default_factory=dict)

    def current(self, entity, prop):
        for row in self.vault:
            if (row["entidad_interna_id"], row["propiedad_origen"]) == (entity, prop):
                if row["estado"] == "VIGENTE":
                    return row
        return None

    def upsert(self, entity, key, prop, value, kind, source, job, at, counts, origin, author):
        cleaned = clean(value, kind)
        sign = hashed(cleaned)
        current = self.current(entity, prop)
        if current and current["firma_auditoria"] == sign:
            counts["registros_sin_cambio"] += 1
            return
        if current:
            current.update(estado="HISTORICO", hasta=at, job_id=job)
            counts["registros_actualizados"] += 1
        else:
            counts["registros_insertados"] += 1
        self.vault.append(
            dict(
                entidad_interna_id=entity, llave_humana_completa=key, propiedad_origen=prop,
                valor_original=None if is_empty(value) else str(value), valor_limpio=cleaned,
                firma_auditoria=sign, tipo_dato_generico=kind, tabla_origen=source,
                origen_dato=origin, creado_por=author, estado="VIGENTE", job_id=job,
                desde=at, hasta=None,
            )
        )

    def live(self, entity, source):
        return sum(
            row["entidad_interna_id"] == entity
            and row["tabla_origen"] == source
            and row["estado"] == "VIGENTE"
            for row in self.vault
        )

    def refine(self, rows, keys, kept, source, job, at):
        counts = dict.fromkeys(
            "filas_procesadas registros_insertados registros_actualizados registros_sin_cambio "
            "registros_eliminados entidades_inactivadas errores".split(), 0
        )
        for row in rows:
            counts["filas_procesadas"] += 1
            parts = ["" if is_empty(row[k]) and row[k] != row[k] else row[k] for k in sorted(keys)]
            key = "|".join("" if part is None else str(part) for part in parts)
            if not key.strip():
                counts["errores"] += 1
                continue
            stored = [
                e for e, i in self.inventory.items()
                if (i["llave_humana_completa"], i["tabla_origen"]) == (key, source)
            ]
            entity = stored[0] if stored else str(uuid.uuid5(uuid.NAMESPACE_DNS, key))
            known = self.inventory.setdefault(entity, {"total_propiedades_activas": 0})
            known.update(
                llave_humana_completa=key, tabla_origen=source, estado_entidad="ACTIVO",
                actualizado_en=at, job_id=job,
            )
            try:
                for name, kind in kept.items():
                    clean(row[name], kind)
            except ValueError:
                counts["errores"] += 1
                continue
            for name, kind in kept.items():
                self.upsert(
                    entity, key, name, row[name], kind, source, job, at, counts,
                    "carga_masiva", None,
                )
            known["total_propiedades_activas"] = self.live(entity, source)
        for entity, known in self.inventory.items():
            if known["tabla_origen"] == source and known["job_id"] != job:
                known.update(
                    estado_entidad="INACTIVO", total_propiedades_activas=0, actualizado_en=at
                )
                counts["entidades_inactivadas"] += 1
                for row in self.vault:
                    if (
                        row["entidad_interna_id"] == entity
                        and row["tabla_origen"] == source
                        and row["estado"] == "VIGENTE"
                    ):
                        row.update(estado="ELIMINADO", hasta=at, job_id=job)
                        counts["registros_eliminados"] += 1
        for entity, known in self.inventory.items():
            if known["tabla_origen"] == source and known["job_id"] == job:
                total = self.live(entity, source)
                if total:
                    known["total_propiedades_activas"] = total
        return counts

    def edit(self, edits, kept, source, job, at):
        counts = dict.fromkeys(
            "registros_insertados registros_actualizados registros_sin_cambio errores".split(), 0
        )
        for edit in edits:
            known = self.inventory.get(edit["entidad_interna_id"])
            kind = kept.get(edit["propiedad"])
            if known is None or known["tabla_origen"] != source or kind is None:
                counts["errores"] += 1
                continue
            try:
                clean(edit["nuevo_valor"], kind)
            except ValueError:
                counts["errores"] += 1
                continue
            self.upsert(
                edit["entidad_interna_id"], known["llave_humana_completa"], edit["propiedad"],
                edit["nuevo_valor"], kind, source, job, at, counts, "edicion_manual",
                edit["usuario_email"],
            )
            known["total_propiedades_activas"] = self.live(edit["entidad_interna_id"], source)
        return counts
